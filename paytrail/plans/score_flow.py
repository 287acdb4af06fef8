"""From payment tables to scores.

Every feature family is computed on a narrow projection of the payments and kept as a table keyed by id. The wide rows
are shuffled once, by id, when the families are attached; no family carries the wide rows through its own joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from paytrail.functions import amounts, keys, strings, times
from paytrail.operators import embed, encode, folds, groups, lookback, model, reduce, sequences
from paytrail.operators import relational as rel
from paytrail.operators.evaluate import auc
from paytrail.sources.scratch import driver_heap, pin

ID, TIME, AMOUNT, LABEL, SPLIT = "TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "split"

# fixed values: columns of each feature family
CARDS = ["card1", "card2", "card3", "card4", "card5", "card6"]
ADDRESSES = ["addr1", "addr2"]
MATCHES = [f"M{i}" for i in range(1, 10)]
ENTITY = [*CARDS, *ADDRESSES, "P_emaildomain"]
ENTITY_NO_MAIL = [*CARDS, *ADDRESSES]
NEAR_KEY = [*CARDS, "addr1", "P_emaildomain"]
SLOPES = ["D1", "D2", "D3", "D4", "D5", "D10"]
DELTAS = ["D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8", "D10"]
PCA_CARDS = ["card1", "card2", "card3", "card5"]
CROSSES = [
    ("id_02", "id_20"), ("id_13", "id_17"), ("id_02", "D8"), ("D11", "DeviceInfo"), ("DeviceInfo", "P_emaildomain"),
    ("P_emaildomain", "C2"), ("P_emaildomain", "card1"), ("P_emaildomain", "card2"), ("card2", "dist1"),
    ("card1", "card5"), ("card2", "id_20"), ("card5", "P_emaildomain"), ("addr1", "card1"), ("card2", "card4"),
    ("card4", "card6"), ("P_emaildomain", "card1", "card2"), ("addr1", "card1", "card2"),
]
WITH_DEVICE_TYPE = ["id_30", "id_31", "id_33", "DeviceInfo"]
LOOKBACKS = {"D15": (ENTITY_NO_MAIL, ENTITY), "D10": (ENTITY_NO_MAIL, ENTITY), "D1": (ENTITY_NO_MAIL,), "D2": (ENTITY_NO_MAIL,), "D4": (ENTITY_NO_MAIL,)}
SHIFTED = ["D10", "D15", "D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8", "D9", "D11", "D12", "D13", "D14"]
# fixed values: last day with labels, first day that is encoded, smallest gap used on labelled rows
LAST_LABELLED_DAY, FIRST_ENCODED_DAY, SMALLEST_GAP = 182, 32, 31


def _has(df: DataFrame, *cols: str) -> bool:
    return set(cols) <= set(df.columns)


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def row_features(df: DataFrame) -> DataFrame:
    """Features that need no other row, in one projection."""
    inputs = [c for c in df.columns if c not in (ID, SPLIT, LABEL)]
    amount, offset = F.col(AMOUNT), F.col(TIME)
    out: dict[str, Column] = {
        "null": amounts.null_count(df, inputs),
        "TransAmtLog": amounts.log_amount(amount),
        "TransAmtDemical": amounts.decimal_len(amount),
        "TransAmt_per_TransDT": amounts.rate_per_day(amount, offset),
        "day_no": times.day_bucket(offset),
        **amounts.mod_flags(amount, AMOUNT),
    }
    at = times.event_time(offset)
    out |= times.calendar_parts(at) | times.day_part_flags(F.hour(at))
    if _has(df, "card1"):
        out |= {f"card1_sub_-{k}": keys.char_from_end(F.col("card1"), k) for k in range(1, 6)}
        out |= {"card1_len": keys.code_len(F.col("card1")), "card1_first": keys.code_char(F.col("card1"))}
    out |= {f"{c}_na": amounts.null_flag(df, c) for c in _present(df, ["card1", "card2", "card5"])}
    out |= {f"{c}_slop": times.gap_slope(F.col(c), offset) for c in _present(df, SLOPES)}
    out |= {f"{c}_delta": times.gap_delta(F.col(c), offset) for c in _present(df, DELTAS)}
    if _has(df, "dist1", "dist2"):
        out |= amounts.pair_arith(F.col("dist1"), F.col("dist2"), "dist1", "dist2")
        out["TransAmt_mul_dist1"] = amount * F.col("dist1")
    if _has(df, "D8", "D9"):
        out["D8_mul_D9"] = F.col("D8") * F.col("D9")
    for c in _present(df, ["P_emaildomain", "R_emaildomain"]):
        out[c.replace("domain", "_suffix")] = strings.domain_suffix(F.col(c))
        out[c.replace("domain", "Corp")] = strings.domain_provider(F.col(c))
    out |= {f"{c}_d": amounts.nonzero_flag(F.col(c)) for c in _present(df, ["id_05", "id_06"])}
    if _has(df, "C5"):
        out["C5_d"] = amounts.nonzero_flag(F.col("C5"), null_as=1)
    if _has(df, "id_02"):
        out["id_02_log"] = amounts.log10_amount(F.col("id_02"))
    if _has(df, "id_30"):
        out |= strings.os_parse(F.col("id_30"))
    if _has(df, "id_31"):
        out["LastestBrowser"] = strings.membership_flag(F.col("id_31"), strings.RECENT_BROWSERS)
        out |= {n: strings.contains_flag(F.col("id_31"), w) for n, w in strings.BROWSER_FLAGS.items()}
        out["BrowserType"] = strings.browser_vendor(F.col("id_31"))
    if _has(df, "id_33"):
        out["DisplaySize"] = strings.screen_pixels(F.col("id_33"))
    if _has(df, "DeviceInfo"):
        out["DeviceCorp"] = strings.device_vendor(F.col("DeviceInfo"))
    if _has(df, "DeviceType"):
        out |= {f"{c}_DeviceType": keys.cross_strict(df, c, "DeviceType") for c in _present(df, WITH_DEVICE_TYPE)}
    out |= {"__".join(cs): keys.cross(df, *cs) for cs in CROSSES if _has(df, *cs)}
    out["uid"] = keys.entity_key(df, _present(df, ENTITY))
    out["uid_card"] = keys.entity_key(df, _present(df, ENTITY_NO_MAIL))
    out["card_str"] = keys.entity_key(df, _present(df, CARDS))
    out["near_key"] = keys.entity_key(df, _present(df, NEAR_KEY))
    return df.withColumns(out)


# fixed values: column, threshold, inclusive, name of the rest
RARE = [
    ("P_emailCorp", 1000, True, "Others"), ("R_emailCorp", 1000, True, "Others"),
    ("BrowserType", 1000, False, "other"), ("DeviceCorp", 100, False, "Other"),
]


def rare_features(df: DataFrame) -> DataFrame | None:
    """Providers, browsers and device vendors with their rare values folded within the split."""
    cols = _present(df, [r[0] for r in RARE])
    if not cols:
        return None
    narrow = df.select(ID, SPLIT, *cols)
    seen = groups.frequencies(narrow, cols, by=[SPLIT], suffix="_seen", unique=[ID])
    out = seen.select(
        ID,
        *[
            F.when(F.col(col).isNotNull() & (F.col(f"{col}_seen") <= threshold - (not inclusive)), other).otherwise(F.col(col)).alias(col)
            for col, threshold, inclusive, other in RARE
            if col in cols
        ],
    )
    if "DeviceCorp" in cols:
        out = out.withColumn("DeviceCorp", F.upper("DeviceCorp"))
    return out


def frequency_features(df: DataFrame) -> DataFrame:
    union = _present(df, [*CARDS, *ADDRESSES, *MATCHES, "card_str"])
    own = _present(df, ["id_30", "id_31", "id_33"])
    narrow = df.select(ID, SPLIT, *union, *own)
    out = groups.frequencies(narrow, union, unique=[ID])
    if own:
        out = groups.frequencies(out, own, by=[SPLIT], suffix="_count", unique=[ID], counted=narrow)
    return out.drop(SPLIT, *union, *own)


def ratio_features(df: DataFrame) -> list[DataFrame]:
    """Ratios to the group statistics of the row's own split."""
    plans = [
        (AMOUNT, _present(df, [*CARDS, "card_str"]), ("mean", "std", "sum")),
        ("id_02", _present(df, ["card1", "card4"]), ("mean", "std")),
        ("D15", _present(df, ["card1", "card4", "addr1"]), ("mean", "std")),
    ]
    out = []
    for value, by_keys, stats in plans:
        if _has(df, value) and by_keys:
            narrow = df.select(ID, SPLIT, value, *by_keys)
            out.append(groups.group_ratios(narrow, value, by_keys, stats, by=[SPLIT], unique=[ID]).drop(SPLIT, value, *by_keys))
    return out


def day_features(df: DataFrame) -> DataFrame:
    """Amounts and hours of the entity on the same day, within the split."""
    narrow = df.select(ID, F.concat_ws("|", SPLIT, "uid").alias("_who"), "day_no", AMOUNT, "Hour")
    out = groups.day_stats(narrow, "_who", "day_no", AMOUNT, "Hour", spread=[ID])
    return groups.same_amount_count(out, "_who", "day_no", AMOUNT, spread=[ID]).drop("_who", "day_no", AMOUNT, "Hour")


def sequence_features(df: DataFrame) -> DataFrame:
    """Gaps and differences to the entity's previous and next payment, and their values, train before test."""
    gaps = _present(df, SHIFTED)
    narrow = df.select(ID, "uid", TIME, AMOUNT, *gaps, F.when(F.col(SPLIT) == "train", 0).otherwise(1).alias("_part"))
    order = ["_part", TIME, ID]
    out = sequences.shift_diffs(narrow, "uid", order, [TIME, AMOUNT])
    if gaps:
        out = sequences.shift_values(out, "uid", order, gaps)
    return out.drop("uid", TIME, AMOUNT, "_part", *gaps)


def neighbour_features(df: DataFrame) -> DataFrame:
    """Repeats of the card key among the 50 rows before and after, within each split."""
    narrow = df.select(ID, F.concat_ws("|", SPLIT, "near_key").alias("_key"), SPLIT)
    parts = [
        sequences.neighbour_count(narrow.filter(F.col(SPLIT) == s), "_key", [ID], "shift_100_cnt").select(ID, "shift_100_cnt")
        for s in ("train", "test")
    ]
    return parts[0].unionByName(parts[1])


def lookback_features(
    df: DataFrame, first_day: int = FIRST_ENCODED_DAY, last_day: int = LAST_LABELLED_DAY, smallest_gap: int = SMALLEST_GAP
) -> list[DataFrame]:
    """Labels of the entity on the day each gap column points to, or the day after, from the labelled rows only."""
    out = []
    for entity, who, mail in ((ENTITY_NO_MAIL, "uid_card", ""), (ENTITY, "uid", "_pEmail")):
        gaps = [gap for gap, entities in LOOKBACKS.items() if gap in df.columns and any(e is entity for e in entities)]
        if not gaps:
            continue
        used = {}
        for gap in gaps:
            whole = F.when(F.col(gap) == F.floor(gap), F.col(gap).cast("long"))  # a gap is a number of whole days
            used[gap] = F.when((F.col(SPLIT) == "test") | (F.col(gap) >= smallest_gap), whole).alias(f"_gap_{gap}")
        out.append(
            lookback.lookback_gaps(
                df.select(ID, who, "day_no", LABEL, *used.values()),
                id=ID,
                entity=who,
                day="day_no",
                gaps={f"{gap}{mail}": f"_gap_{gap}" for gap in gaps},
                measure=LABEL,
                offsets=(0, 1),
                pick="first",
                day_range=(first_day, None),
                target_range=(1, last_day),
            )
        )
    return out


def code_features(df: DataFrame, text: Sequence[str]) -> DataFrame:
    """Every text column as the rank of its value over all splits."""
    return encode.label_encode(df.select(ID, *text), text, unique=[ID])


def card_components(df: DataFrame) -> DataFrame | None:
    cols = _present(df, PCA_CARDS)
    if len(cols) < 2:
        return None
    filled = rel.fill_by_type(df.select(ID, SPLIT, *cols), cols=cols)
    fitted = reduce.fit_pca(filled.filter(F.col(SPLIT) == "train"), cols, min(3, len(cols)))
    return reduce.apply_pca(fitted, filled).drop(SPLIT, *cols)


# fixed values: categories of the token sentences, and the groups that make a token of their own
CATEGORIES = ["P_emaildomain", "ProductCD", "R_emaildomain", *MATCHES, *ADDRESSES, *CARDS, *[f"id_{i}" for i in range(12, 39)], "DeviceType", "DeviceInfo"]
TOKEN_GROUPS = [["P_emaildomain", "R_emaildomain"], MATCHES, ADDRESSES, CARDS]
TOKEN_BINS = 256


def card_vectors(df: DataFrame, size: int = 50) -> DataFrame:
    """Vector of the row's card-group token, learned from all rows as sentences of coded categories, binned numbers and four group tokens."""
    cats = _present(df, CATEGORIES)
    inputs = [f"C{i}" for i in range(1, 15)] + [f"D{i}" for i in range(1, 16)] + [f"V{i}" for i in range(1, 340)] + [f"id_{i:02d}" for i in range(1, 12)]
    numbers = _present(df, [AMOUNT, "dist1", "dist2", *inputs])
    filled = rel.fill_by_type(df.select(ID, *cats, *numbers), number=-1.0, cols=numbers)
    binned = encode.approx_bins(filled, [n for n in numbers if n not in rel.columns_of_type(df, "string")], TOKEN_BINS)
    coded = encode.category_codes(binned, cats, unique=[ID])
    named = [(f"_group{i}", _present(df, g)) for i, g in enumerate(TOKEN_GROUPS)]
    named = [(n, g) for n, g in named if g]
    coded = pin(coded.withColumns({n: embed.group_token(coded, g) for n, g in named}), "sentences").df
    learned = embed.train_tokens(coded.select(embed.sentence(coded, [c for c in coded.columns if c != ID]).alias("tokens")), "tokens", size=size)
    cards = next(n for n, g in named if g == _present(df, CARDS))
    vectors = embed.embed_token(coded.select(ID, cards), cards, learned, size, spread=[ID]).drop(cards)
    return vectors.withColumnsRenamed({f"{cards}_{i}": f"_cards_{i}" for i in range(size)})


FAMILIES_AT_ONCE = 4  # the steps of a family are short jobs one after another, which leave most cores idle
FAMILY_HEAP = 512 << 20  # of the driver for each, which plans its steps and builds its broadcasts


def _side_by_side(spark: SparkSession, families: Sequence[Callable[[], Sequence[DataFrame]]]) -> list[DataFrame]:
    """What the functions return, in their order. The last ones, which take longest, are begun first."""
    with ThreadPool(max(1, min(FAMILIES_AT_ONCE, driver_heap(spark) // FAMILY_HEAP))) as pool:
        built = pool.map(inheritable_thread_target(spark)(lambda family: family()), families[::-1], chunksize=1)
    return [table for tables in built[::-1] for table in tables]


def _written(family: Callable[[], Sequence[DataFrame]]) -> Callable[[], list[DataFrame]]:
    """The family with each table written by a query of its own. In one query over all families the driver would plan all their lookups anew whenever a stage ends, and hold all their broadcasts."""
    return lambda: [pin(table, "features").df for table in family()]


def build_matrix(
    train: DataFrame, test: DataFrame, extra: Sequence[DataFrame] = (), vector_size: int | None = None, **lookback_days: int
) -> DataFrame:
    """Union of the splits with all features; text is coded. ``extra`` are ready-made feature tables keyed by id."""
    whole = rel.union_splits({"train": train, "test": test}, SPLIT)
    base = pin(row_features(rel.nan_to_null(whole)), "row-features").df
    if "DisplaySize" in base.columns:
        low = base.groupBy(SPLIT).agg(F.min("DisplaySize").alias("_low"))  # one row per split
        base = base.join(F.broadcast(low), SPLIT, "left")
        base = base.withColumn("DisplaySize", F.round(F.try_divide("DisplaySize", "_low"), 0)).drop("_low")

    helpers = ["uid", "uid_card", "card_str", "near_key"]
    folded = _present(base, [r[0] for r in RARE])
    text = [c for c in rel.columns_of_type(base, "string") if c not in (*helpers, *folded, SPLIT)]

    def components() -> list[DataFrame]:
        found = card_components(base)
        return [] if found is None else [found]

    families = [
        lambda: [frequency_features(base)], lambda: ratio_features(base), lambda: [day_features(base)], lambda: [sequence_features(base)],
        lambda: [neighbour_features(base)], lambda: lookback_features(base, **lookback_days), components,
    ]
    if vector_size:
        families.append(lambda: [card_vectors(base, vector_size)])
    if folded:
        families.append(lambda: [code_features(rare_features(base), folded)])
    families.append(lambda: [code_features(base, text)])
    numbers = base.drop(*text, *folded, *helpers)
    return rel.attach_features(numbers, ID, [*_side_by_side(base.sparkSession, [_written(f) for f in families]), *extra])


def score(
    matrix: DataFrame, *, k: int = 5, first: int = 3, params: Mapping | None = None, drop: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Scores of the unlabelled rows (mean of the first folds) and the AUC of each fold. The matrix is assembled and written once."""
    features = [c for c in matrix.columns if c not in (ID, LABEL, SPLIT, *drop)]
    kept = [c for c in (ID, LABEL, SPLIT, TIME) if c in matrix.columns]
    ready = model.packed(model.assemble(matrix, features).select(*kept, "features"), "matrix").df
    train = folds.kfold_contiguous(rel.take_split(ready, "train", SPLIT), [TIME, ID], k)
    test = rel.take_split(ready, "test", SPLIT)
    _, valid, scored = model.cross_fit(train, test, id=ID, label=LABEL, features=None, first=first, params=params)
    scores = model.blend(scored, ID, first).withColumnRenamed("score", LABEL)
    return scores, auc(valid, LABEL, "score", ["fold"])


def offline_experiment(
    labelled: DataFrame, *, first: int = 4, params: Mapping | None = None, drop: Sequence[str] = (), **matrix_args
) -> tuple[DataFrame, DataFrame]:
    """Train on the early half, score the rest: AUC of the two later parts, and of the folds.

    This is how a feature set is judged before it is used: fold AUC alone does not show the overfit of label features.
    """
    parts = pin(folds.holdout_split(labelled, [ID]), "holdout").df
    early, late = parts.filter("part = 'train'").drop("part"), parts.filter("part <> 'train'")
    scores, fold_auc = score(build_matrix(early, late.drop("part", LABEL), **matrix_args), first=first, params=params, drop=drop)
    judged = late.select(ID, "part", F.col(LABEL).alias("truth")).join(scores.withColumnRenamed(LABEL, "score"), ID, "left")
    return auc(judged, "truth", "score", ["part"]), fold_auc
