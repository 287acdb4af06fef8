"""Column -> Column builders: no state, no shuffle, all inside whole-stage codegen."""
