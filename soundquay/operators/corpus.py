"""Corpus building: grids, splits, samples, training draws. All choices are repeatable."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.text import hash_number, md5_order, uniform_hash
from soundquay.operators.order import first_k, number_rows
from soundquay.sources.stage import stage_table
from soundquay.sources.constants import constant_table


def levels_table(spark: SparkSession, levels: Sequence[str] = fixed.CANONICAL_LEVELS) -> DataFrame:
    rows = [
        (i, level, fixed.LEVEL_SNR_DB[level], *fixed.SNR_BANDS_DB.get(level, (None, None)))
        for i, level in enumerate(levels)
    ]
    return constant_table(
        spark,
        rows, "level_pos long, noise_level string, snr_db double, snr_low double, snr_high double"
    )


def mixed_id(clean_id: Column, subtype: Column, level: Column) -> Column:
    return F.concat(clean_id, F.lit("__noise-"), subtype, F.lit("-"), level)


def mix_seed(base: int, clean_id: Column, clip_id: Column, level: Column) -> Column:
    """The first eight hex digits of a SHA-256 over the parts of the mix."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(base)), clean_id, clip_id, level), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def renumber(manifest: DataFrame) -> DataFrame:
    """``cl-<lang>-00000`` ids in (source, path) order per language."""
    numbered = number_rows(manifest, ["source", "path"], ["lang"], "_seq")
    return numbered.withColumn(
        "utterance_id",
        F.concat(F.lit("cl-"), F.col("lang"), F.lit("-"), F.format_string("%05d", F.col("_seq"))),
    ).drop("_seq")


def number_clips(clips: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nz-<SUB>-0000`` ids by order inside a subtype."""
    numbered = number_rows(clips, order, ["subtype"], "_seq")
    return numbered.withColumn(
        "clip_id",
        F.concat(F.lit("nz-"), F.col("subtype"), F.lit("-"), F.format_string("%04d", F.col("_seq"))),
    ).drop("_seq")


def take_until(
    df: DataFrame, order: Sequence[str], value: str, limit: float, within: Sequence[str] = ()
) -> DataFrame:
    """Rows in order until the running total reaches ``limit``; the crossing row is kept."""
    totals = number_rows(df, order, within, "_at", value=F.col(value), before="_before")
    return totals.filter(F.col("_before") < limit).drop("_at", "_before")


def hold_out_speakers(
    utterances: DataFrame, share: float, seed: int, min_rows: int = 0
) -> DataFrame:
    """Speakers held out per accent, topped up in shuffled order to ``min_rows`` utterances.

    ``max(1, round(n * share))`` speakers of each accent; the rows needed beyond them come from
    further speakers in one global shuffled order.
    """
    speakers = utterances.groupBy("accent", "speaker").agg(F.count(F.lit(1)).alias("n_rows"))
    shuffled = speakers.withColumn("_order", md5_order(F.col("speaker"), seed))
    ranked = number_rows(shuffled, ["_order", "speaker"], ["accent"], "_place")
    sizes = speakers.groupBy("accent").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)))
    marked = ranked.join(sizes, "accent").withColumn("_held", F.col("_place") < wanted)
    have = marked.filter("_held").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("_have"))
    spare = number_rows(
        marked.filter("not _held").select("accent", "speaker", "n_rows", "_order"),
        ["_order", "accent", "speaker"],
        (),
        "_at",
        value=F.col("n_rows"),
        before="_before",
    )
    top_up = spare.crossJoin(F.broadcast(have)).filter(  # one row
        F.col("_have") + F.col("_before") < min_rows
    )
    return (
        marked.filter("_held")
        .select("accent", "speaker", "n_rows", F.lit("stratum").alias("reason"))
        .unionByName(top_up.select("accent", "speaker", "n_rows", F.lit("top_up").alias("reason")))
    )


def split_recordings(clips: DataFrame, share: float, seed: int) -> DataFrame:
    """Whole recordings go to eval until ``max(1, round(n * share))`` are there, per subtype."""
    recordings = clips.select("subtype", "recording_id").distinct()
    ranked = number_rows(
        recordings.withColumn("_order", md5_order(F.col("recording_id"), seed)),
        ["_order", "recording_id"],
        ["subtype"],
        "_place",
    )
    sizes = recordings.groupBy("subtype").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)))
    return ranked.join(sizes, "subtype").select(
        "subtype",
        "recording_id",
        F.when(F.col("_place") < wanted, "eval").otherwise("train").alias("split"),
    )


def split_stream(df: DataFrame, signal: str, eval_share: float) -> DataFrame:
    """Front of a signal for training, its end for evaluation."""
    cut = F.floor(F.size(signal) * F.lit(1.0 - eval_share)).cast("int")
    parts = F.array(
        F.struct(F.lit("train").alias("split"), F.slice(signal, 1, cut).alias("part")),
        F.struct(
            F.lit("eval").alias("split"),
            F.slice(signal, cut + 1, F.size(signal) - cut).alias("part"),
        ),
    )
    return df.select(*[c for c in df.columns if c != signal], F.inline(parts))


def sample_cells(
    df: DataFrame, cell: Sequence[str], key: str, per_cell: int, seed: int = fixed.SEED
) -> DataFrame:
    """At most ``per_cell`` rows of each cell, chosen by a seeded shuffle."""
    return first_k(df, cell, [md5_order(F.col(key), seed), F.col(key)], per_cell)


def sample_distinct(
    df: DataFrame, cell: Sequence[str], key: str, per_cell: int, seed: int = fixed.SEED
) -> DataFrame:
    """The same for the distinct keys of each cell (columns ``cell`` and ``key``).

    Each task keeps the first distinct keys of its own rows while it reads them, so it holds a
    batch and ``per_cell`` rows of each cell, and only these are dealt out, made distinct and ranked.
    """
    rows = df.select(*cell, key, md5_order(F.col(key), seed).alias("_order"))

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch])
            batch = batch.drop_duplicates().sort_values(["_order", key])
            kept = batch.groupby(list(cell), dropna=False, sort=False).head(per_cell)
        if kept is not None:
            yield kept

    few = rows.mapInPandas(firsts, rows.schema).distinct()
    return first_k(few, cell, ["_order", key], per_cell).drop("_order")


def control_sample(
    df: DataFrame, key: str, share: float = fixed.CONTROL_SHARE, seed: int = fixed.SEED
) -> DataFrame:
    """``round(n * share)`` rows by a seeded shuffle, whatever the table size."""
    shuffled = df.withColumn("_order", md5_order(F.col(key), seed))
    ranked = number_rows(shuffled, ["_order", key], (), "_place")
    wanted = df.agg(F.bround(F.count(F.lit(1)) * F.lit(share)).cast("long").alias("_k"))
    return (
        ranked.crossJoin(F.broadcast(wanted))  # one row
        .filter(F.col("_place") < F.col("_k"))
        .drop("_order", "_place", "_k")
    )


def head_rows(df: DataFrame, order: Sequence[str], k: int, within: Sequence[str]) -> DataFrame:
    return first_k(df, within, list(order), k)


def regression_corpus(
    domain: DataFrame, general: DataFrame, n_keyword: int = 120, n_generic: int = 50
) -> DataFrame:
    """Keyword-bearing rows and general rows, first k per language, with their own ids."""

    def part(df: DataFrame, name: str, prefix: str, k: int, keywords: Column) -> DataFrame:
        return head_rows(df, ["utterance_id"], k, ["lang"]).select(
            F.concat_ws("-", F.lit(prefix), "lang", "utterance_id").alias("utterance_id"),
            "lang",
            "text",
            F.lit(name).alias("part"),
            keywords.alias("keywords"),
        )

    none = F.array().cast("array<string>")
    return part(
        domain.filter(F.size("keywords") > 0), "keyword", "rk", n_keyword, F.col("keywords")
    ).unionByName(part(general, "generic", "rg", n_generic, none))


def noise_grid(
    clean: DataFrame,
    clips: DataFrame,
    levels: DataFrame,
    order: str = "utterance_id",
    seed: int = fixed.SEED,
) -> DataFrame:
    """Every clean utterance x subtype x level with clips dealt in turn inside a subtype.

    The k-th draw of a subtype takes clip ``k mod n``; k has a closed form (place of the
    utterance times the number of levels plus the place of the level), so nothing is sequential.
    """
    placed = number_rows(clean, [order], ["lang"], "_pos")
    dealt = number_rows(clips.select("subtype", "clip_id"), ["clip_id"], ["subtype"], "_idx")
    sizes = clips.groupBy("subtype").agg(F.count(F.lit(1)).alias("_n"))
    cells = sizes.crossJoin(levels).withColumn(  # subtypes x levels: a fixed small grid
        "_n_levels", F.count(F.lit(1)).over(Window.partitionBy("subtype"))
    )
    grid = placed.crossJoin(F.broadcast(cells)).withColumn(
        "_idx",
        F.pmod(F.col("_pos") * F.col("_n_levels") + F.col("level_pos"), F.col("_n")),
    )
    return grid.join(dealt, ["subtype", "_idx"]).select(
        mixed_id(F.col(order), F.col("subtype"), F.col("noise_level")).alias("utterance_id"),
        "lang",
        "text",
        F.col(order).alias("clean_id"),
        F.col("subtype").alias("noise_subtype"),
        "noise_level",
        F.col("clip_id").alias("noise_clip_id"),
        F.col("snr_db").alias("snr_db_target"),
        mix_seed(seed, F.col(order), F.col("clip_id"), F.col("noise_level")).alias("mix_seed"),
    )


def eval_noisy_grid(
    pool: DataFrame,
    clips: DataFrame,
    levels: DataFrame,
    per_cell: int,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Frozen noisy set: subtype x level x ``per_cell``; pool and clips are dealt in turn.

    The signal-to-noise ratio is uniform in the band of the level.
    """
    spark = pool.sparkSession
    people = number_rows(pool.select("lang", "utterance_id", "text"), ["utterance_id"], ["lang"],
                         "_pool_idx")
    pool_sizes = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("_pool_n"))
    dealt = number_rows(clips.select("subtype", "clip_id"), ["clip_id"], ["subtype"], "_idx")
    sizes = clips.groupBy("subtype").agg(F.count(F.lit(1)).alias("_n"))
    slots = spark.range(per_cell).withColumnRenamed("id", "slot")
    cells = (
        slots.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(levels))
        .crossJoin(F.broadcast(pool_sizes))  # the grid itself is the wanted output
        .withColumn("_pool_idx", F.pmod("slot", "_pool_n"))
        .withColumn("_idx", F.pmod(F.col("level_pos") * per_cell + F.col("slot"), F.col("_n")))
    )
    uid = F.concat_ws(
        "-", F.lit("en"), "lang", "subtype", "noise_level", F.format_string("%03d", F.col("slot"))
    )
    u = uniform_hash(F.col("lang"), F.col("subtype"), F.col("noise_level"), F.col("slot"), seed=seed)
    return (
        cells.join(people, ["lang", "_pool_idx"])
        .join(dealt, ["subtype", "_idx"])
        .select(
            uid.alias("utterance_id"),
            "lang",
            "text",
            F.col("utterance_id").alias("clean_id"),
            F.col("subtype").alias("noise_subtype"),
            "noise_level",
            F.col("clip_id").alias("noise_clip_id"),
            F.round(
                F.col("snr_low") + u * (F.col("snr_high") - F.col("snr_low")), 2
            ).alias("snr_db_target"),
        )
    )


def reserved_ids(*manifests: DataFrame) -> DataFrame:
    """Ids and clean ids already used by evaluation sets."""
    ids = None
    for manifest in manifests:
        for column in ("utterance_id", "clean_id"):
            part = manifest.select(F.col(column).alias("utterance_id")).filter(
                F.col("utterance_id").isNotNull()
            )
            ids = part if ids is None else ids.union(part)
    return ids.distinct()


def clean_pool(reserved: DataFrame, *manifests: DataFrame) -> DataFrame:
    """All clean rows that no evaluation set has taken."""
    pool = manifests[0]
    for other in manifests[1:]:
        pool = pool.unionByName(other, allowMissingColumns=True)
    return pool.join(reserved, "utterance_id", "left_anti")


def weighted_pick(df: DataFrame, u: str, weights: DataFrame, pick: str) -> DataFrame:
    """Choose per row the entry whose cumulative weight interval holds ``u`` (per language).

    The cumulative table has one row per language and subtype, so it travels as one array per
    language and the row-level choice is an array lookup, not a range join.
    """
    upto = Window.partitionBy("lang").orderBy(pick)
    table = (
        weights.withColumn("_high", F.sum("weight").over(upto))
        .groupBy("lang")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("_high"), F.col(pick)))).alias("_cumulative")
        )
    )
    chosen = F.coalesce(
        F.get(F.filter("_cumulative", lambda c: c["_high"] > F.col(u)), F.lit(0))[pick],
        F.element_at("_cumulative", -1)[pick],  # rounding at the upper end
    )
    return df.join(F.broadcast(table), "lang").withColumn(pick, chosen).drop("_cumulative")


def _drawn(pool: DataFrame, n_draws: int, u, clean_share: float) -> DataFrame:
    """The first ``n_draws`` draws with the pool utterance that each takes."""
    draws = (
        pool.sparkSession.range(n_draws)
        .withColumnRenamed("id", "draw")
        .withColumn("lang", F.when(u(0) < 0.5, "es").otherwise("en"))
        .withColumn("is_clean", u(1) < clean_share)
        .withColumn("_u_subtype", u(2))
    )
    sizes = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("_pool_n"))
    picked = draws.join(F.broadcast(sizes), "lang").withColumn(
        "_pool_idx", F.floor(u(3) * F.col("_pool_n"))
    )
    return picked.join(pool, ["lang", "_pool_idx"])


def draw_training(
    pool: DataFrame,
    clips: DataFrame,
    weights: DataFrame,
    levels: DataFrame,
    target_hours: float,
    seed: int = fixed.SEED,
    clean_share: float = fixed.CLEAN_SHARE,
) -> DataFrame:
    """Damage-weighted training rows until ``target_hours`` of audio are drawn.

    Every choice of draw ``i`` is a hash of (seed, i, choice), so draws are independent of
    partitioning and a lost executor recomputes the same rows. The sequence is drawn in rounds,
    each twice as long, until it reaches the target. Clean rows need no noise clip; a subtype with
    a weight but without clips is an error, and so is a pool without audio.
    """

    def u(k: int) -> Column:
        return uniform_hash(F.col("draw"), F.lit(k), seed=seed)

    missing = weights.filter("weight > 0").join(
        clips.select(F.col("subtype").alias("noise_subtype")).distinct(), "noise_subtype", "left_anti"
    )
    lacking = sorted({r["noise_subtype"] for r in missing.select("noise_subtype").collect()})
    if lacking:
        raise ValueError(f"weighted subtypes without clips: {', '.join(lacking)}")
    people = stage_table(
        number_rows(
            pool.select("lang", "utterance_id", "text", "duration_s"), ["utterance_id"], ["lang"],
            "_pool_idx",
        ),
        "training-pool",
    )
    mean = people.agg(F.avg("duration_s")).first()[0]
    if not mean or mean <= 0:
        raise ValueError("the pool holds no audio")
    target = target_hours * 3600.0
    n_draws = int(target / mean * 1.1) + 64
    while (
        _drawn(people, n_draws, u, clean_share).agg(F.sum("duration_s")).first()[0] or 0.0
    ) < target:
        n_draws *= 2
    kept = take_until(_drawn(people, n_draws, u, clean_share), ["draw"], "duration_s", target)
    noisy = weighted_pick(kept, "_u_subtype", weights, "noise_subtype")
    sizes = clips.groupBy("subtype").agg(F.count(F.lit(1)).alias("_n"))
    dealt = number_rows(clips.select("subtype", "clip_id"), ["clip_id"], ["subtype"], "_idx")
    banded = (
        noisy.withColumn("_level_pos", F.floor(u(4) * F.lit(levels.count())))
        .join(F.broadcast(levels), F.col("_level_pos") == F.col("level_pos"))
        .join(F.broadcast(sizes), F.col("noise_subtype") == F.col("subtype"), "left")
        .withColumn("_idx", F.floor(u(5) * F.col("_n")))
        .drop("subtype")
    )
    clipped = banded.join(
        dealt.withColumnRenamed("subtype", "noise_subtype"), ["noise_subtype", "_idx"], "left"
    )

    def noisy_only(value: Column) -> Column:
        return F.when(~F.col("is_clean"), value)

    snr = F.col("snr_low") + u(6) * (F.col("snr_high") - F.col("snr_low"))
    return clipped.select(
        F.concat(F.lit("tn-"), "lang", F.lit("-"), F.format_string("%06d", F.col("draw"))).alias(
            "utterance_id"
        ),
        "lang",
        "text",
        "duration_s",
        F.col("utterance_id").alias("clean_id"),
        noisy_only(F.col("noise_subtype")).alias("noise_subtype"),
        noisy_only(F.col("noise_level")).alias("noise_band"),
        noisy_only(F.col("clip_id")).alias("noise_clip_id"),
        noisy_only(F.round(snr, 2)).alias("snr_db_target"),
    )


def target_utterances(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Utterances with at least one keyword among the targets (``target``, per language)."""
    words = manifest.select("utterance_id", "lang", F.explode("keywords").alias("target"))
    hits = words.join(targets.select("lang", "target").distinct(), ["lang", "target"], "left_semi")
    return manifest.join(hits.select("utterance_id").distinct(), "utterance_id", "left_semi")


def _choice(n: Column, *parts: Column, seed: int) -> Column:
    return F.pmod(hash_number(*parts, seed=seed), n)


def coverage_sentences(targets: DataFrame, templates: DataFrame, seed: int = fixed.SEED):
    """One sentence per keyword target, so that every target is said at least once.

    ``templates(lang, template_no, template)`` with the slot ``{w}``, numbered from 0.
    """
    sizes = templates.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    chosen = targets.join(F.broadcast(sizes), "lang").withColumn(
        "template_no", _choice(F.col("_n"), F.col("lang"), F.col("target"), seed=seed)
    )
    return chosen.join(templates, ["lang", "template_no"]).select(
        "lang",
        "target",
        F.replace(F.col("template"), F.lit("{w}"), F.col("target")).alias("text"),
        F.array("target").alias("keywords"),
    )


def order_sentences(
    draws: DataFrame,
    key: str,
    templates: DataFrame,
    items: DataFrame,
    pool: DataFrame,
    seed: int = fixed.SEED,
) -> DataFrame:
    """One order sentence per row of ``draws(key, lang)``.

    Slot ``{a}`` takes an item, ``{b}`` an entry of the wider pool (``lang, pos, term``, numbered
    from 0 per language); only the terms that the template uses become keywords.
    """
    def sized(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("lang").agg(F.count(F.lit(1)).alias(name))

    sizes = (
        sized(templates, "_nt").join(sized(items, "_na"), "lang").join(sized(pool, "_nb"), "lang")
    )
    chosen = (
        draws.join(F.broadcast(sizes), "lang")
        .withColumn("template_no", _choice(F.col("_nt"), F.col(key), F.lit("t"), seed=seed))
        .withColumn("_a", _choice(F.col("_na"), F.col(key), F.lit("a"), seed=seed))
        .withColumn("_b", _choice(F.col("_nb"), F.col(key), F.lit("b"), seed=seed))
    )
    named = (
        chosen.join(templates, ["lang", "template_no"])
        .join(items.select("lang", F.col("pos").alias("_a"), F.col("term").alias("a")), ["lang", "_a"])
        .join(pool.select("lang", F.col("pos").alias("_b"), F.col("term").alias("b")), ["lang", "_b"])
    )
    text = F.replace(
        F.replace(F.col("template"), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")
    )
    used = F.array_compact(
        F.array(F.col("a"), F.when(F.col("template").contains("{b}"), F.col("b")))
    )
    return named.select(
        key, "lang", text.alias("text"), F.array_sort(F.array_distinct(used)).alias("keywords")
    )


def rotate(df: DataFrame, order: Sequence[str], choices: Sequence[str], name: str) -> DataFrame:
    """Give row i the choice ``i mod n``."""
    numbered = number_rows(df, order, (), "_i")
    table = F.array(*[F.lit(c) for c in choices])
    return numbered.withColumn(
        name, F.get(table, F.pmod(F.col("_i"), F.lit(len(choices))).cast("int"))
    ).drop("_i")
