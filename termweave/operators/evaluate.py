"""Evaluation: score sheets, consensus, recall, coverage and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import entity_alias, strip
from termweave.operators.bootstrap import intervals
from termweave.operators.dedup import first_by
from termweave.sources.sinks import staged


def run_accuracy(df: DataFrame, keys: list[str], score: Column, lenient: Column | None = None) -> DataFrame:
    """acc2 (percent of score 2), acc21 (of 1 and more; only where ``lenient``), wavg (mean of half the score, percent); null over nothing."""
    share = lambda c: F.avg(F.when(score.isNotNull(), c.cast("double"))) * 100
    acc21 = share(score >= 1)
    return df.groupBy(*keys).agg(share(score == 2).alias("acc2"), (F.when(F.max(lenient.cast("int")) == 1, acc21) if lenient is not None else acc21).alias("acc21"), (F.avg(score / 2) * 100).alias("wavg"))


def concept_average(df: DataFrame, domain: str, score: Column) -> DataFrame:
    return df.groupBy(domain).agg((F.avg(score / 2) * 100).alias("wavg"))


def macro_average(df: DataFrame, value: str = "wavg") -> DataFrame:
    return df.agg(F.avg(value).alias("macro"))


def pools(df: DataFrame, key: str, item: str, arms: dict[str, Column]) -> DataFrame:
    """key and, for each arm, the set of items of its rows over all runs."""
    return df.groupBy(key).agg(*(F.array_sort(F.collect_set(F.when(where, F.col(item)))).alias(name) for name, where in arms.items()))


def recall_at_k(pool: str, gold: str) -> Column:
    """Share of entities whose pool meets their gold set."""
    return F.avg(F.arrays_overlap(pool, gold).cast("double"))


def recall_at_1(hits: Column, cells: Column) -> Column:
    """Hits over cells, both summed; entities without a cell don't count."""
    return F.try_divide(F.sum(hits), F.sum(cells))


def coverage(score: Column) -> Column:
    return F.count(score) / F.count(F.lit(1))


def recall_covered(score: Column, least: float = 2) -> Column:
    return F.avg(F.when(score.isNotNull(), (score >= least).cast("double")))


def bootstrap(df: DataFrame, key: str, hits: str, cells: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """low, high: the 95 % percentile interval of sum(hits) / sum(cells) when entities are drawn with replacement."""
    one = intervals(df, F.col(key), F.array(F.lit("All")), {"ratio": (F.col(hits), F.col(cells))}, replicates, seed)
    return one.select("low", "high")


#: Least score of an exact and of an acceptable answer. Fixed values.
LEAST = {"E": 2, "A": 1}


def performance(entities: DataFrame, externals: list[str], arms: list[str], full_arm: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """level, method, metric, n, coverage, point, low, high: how often each method finds an entity's answer.

    ``entities``: file, name, grp, domain, seq, gold_E and gold_A (the ids that count),
    run_scores (the full pipeline's scores, an entry a run), a score column for each of ``externals`` and a
    column with the pool of ids for each of ``arms``. Levels are each group's domains, each
    group, and All, which is the groups together; for the last two an entity counts once for each (file, name), as it
    came first. Metrics: r1, the share of scored cells that reach the level E or A; rk, the
    share of entities whose pool meets the gold set. Externals have a coverage, the share of
    entities that they score.
    """
    seen = first_by(entities.select("file", "name", "grp", "domain", "seq"), ["file", "name"], F.col("seq").asc()).select("file", "name", F.col("seq").alias("first"))
    rows = entities.join(seen, (entities["file"].eqNullSafe(seen["file"])) & (entities["name"].eqNullSafe(seen["name"]))).drop(seen["file"]).drop(seen["name"])
    own = F.concat_ws("-", "grp", "domain")
    once = F.when(F.col("seq") == F.col("first"), F.array(F.lit("All"), F.col("grp"), own)).otherwise(F.array(own))
    reach = lambda c, x: (c >= LEAST[x]).cast("int")
    ratios: dict[str, tuple[Column, Column]] = {"n": (F.lit(1), F.lit(1))}
    for e in externals:
        ratios |= {f"{e}/r1_{x}": (reach(F.col(e), x), F.col(e).isNotNull().cast("int")) for x in LEAST}
        ratios[f"{e}/coverage"] = (F.col(e).isNotNull().cast("int"), F.lit(1))
    for a in arms:
        ratios |= {f"{a}/rk_{x}": (F.coalesce(F.arrays_overlap(a, f"gold_{x}"), F.lit(False)).cast("int"), F.lit(1)) for x in LEAST}
    cells = F.filter("run_scores", lambda s: s.isNotNull())
    reached = lambda least: F.size(F.filter(cells, lambda s: s >= least))
    ratios |= {f"{full_arm}/r1_{x}": (reached(least), F.size(cells)) for x, least in LEAST.items()}
    found = staged(intervals(rows, F.concat_ws("/", "file", "name", "domain"), once, ratios, replicates, seed), "intervals")  # a row a level and ratio
    n = rows.select(F.explode(once).alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    parts = found.where("ratio <> 'n'").withColumn("method", F.substring_index("ratio", "/", 1)).withColumn("metric", F.substring_index("ratio", "/", -1))
    covered = parts.where("metric = 'coverage'").select("level", "method", F.col("point").alias("coverage"))
    return parts.where("metric <> 'coverage'").join(n, "level").join(covered, ["level", "method"], "left").select("level", "method", "metric", "n", "coverage", "point", "low", "high")


def consensus(agreed: DataFrame, decided: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Both sheets' scores; where both have one the decided one holds."""
    joined = agreed.withColumnRenamed(score, "_a").join(decided.withColumnRenamed(score, "_d"), keys, "full")
    return joined.select(*keys, F.coalesce("_d", "_a").alias(score))


def missing_pairs(pairs: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.join(scored, keys, "left_anti")


def unique_names(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name occurs once."""
    once = df.groupBy(name).agg(F.count("*").alias("_n")).where("_n = 1").select(name)
    return df.join(once, name, "left_semi")


def index_offset(left: DataFrame, right: DataFrame, name: str, index: str) -> DataFrame:
    """One row: the most frequent right minus left index among names unique on both sides, the smallest among equals."""
    a = unique_names(left, name).select(name, F.col(index).alias("_l"))
    b = unique_names(right, name).select(name, F.col(index).alias("_r"))
    return a.join(b, name).groupBy((F.col("_r") - F.col("_l")).alias("offset")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "offset").limit(1)


def join_by_offset(left: DataFrame, right: DataFrame, offset: DataFrame, index: str, how: str = "left") -> DataFrame:
    moved = left.join(F.broadcast(offset.select("offset"))).withColumn("_at", F.col(index) + F.col("offset")).drop("offset")  # one row
    return moved.join(right.withColumnRenamed(index, "_at"), "_at", how).drop("_at")


def join_by_name_or_alias(left: DataFrame, right: DataFrame, name: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the equal name, else of the name without its trailing parenthesis."""
    exact = right.select(name, F.col(value).alias("_exact"))
    other = right.select(F.col(name).alias("_alias"), F.col(value).alias("_other"))
    joined = left.join(exact, name, "left").withColumn("_alias", entity_alias(F.col(name))).join(other, "_alias", "left")
    return joined.withColumn(value, F.coalesce("_exact", "_other")).drop("_exact", "_other", "_alias")


def cascade_scores(asked: DataFrame, scored: DataFrame) -> DataFrame:
    """entity, concept, score, found: by entity and concept, else by the concept's id alone, else the entity's only score.

    ``asked``: entity, concept, concept_id; ``scored``: the same and score.
    """
    exact = scored.select("entity", "concept", F.col("score").alias("s1"))
    by_id = first_by(scored.where("concept_id is not null"), ["entity", "concept_id"], F.col("concept").asc()).select("entity", "concept_id", F.col("score").alias("s2"))
    only = scored.groupBy("entity").agg(F.count("*").alias("_n"), F.first("score").alias("s3")).where("_n = 1").drop("_n")
    joined = asked.join(exact, ["entity", "concept"], "left").join(by_id, ["entity", "concept_id"], "left").join(only, "entity", "left")
    found = F.when(F.col("s1").isNotNull(), "exact").when(F.col("s2").isNotNull(), "id").when(F.col("s3").isNotNull(), "only")
    return joined.select("entity", "concept", F.coalesce("s1", "s2", "s3").alias("score"), found.alias("found"))


#: Different characters of ids by which ``id_pieces`` cuts texts; with more, texts stay whole.
MOST_LETTERS = 1000


def id_pieces(texts: DataFrame, ids: DataFrame, text: str = "other", idcol: str = "id") -> DataFrame:
    """``texts`` with a row for each distinct piece of the text that may be an id: of an id's length, and of letters that ids have.

    So ids are found in texts by an equality of pieces. There are at most as many rows
    for a text as it has letters times the ids' lengths; of ids of digits only its digits count.
    """
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.length(idcol), F.lit(1))), lambda i: F.substr(idcol, i, F.lit(1)))
    # A number a length and a row a letter come to the driver, however many ids there are.
    sizes = sorted(r[0] for r in ids.where(F.col(idcol).isNotNull()).select(F.length(idcol)).distinct().collect())
    used = [r[0] for r in ids.select(F.explode(letters).alias("l")).where("l <> ''").distinct().limit(MOST_LETTERS + 1).collect()]
    runs = F.array(text)
    if 0 < len(used) <= MOST_LETTERS:
        runs = F.split(text, "[^" + "".join(f"\\x{{{ord(x):x}}}" for x in used) + "]+")
    none = F.array().cast("array<string>")

    def of_size(n: int) -> Column:
        cut = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substr(run, i, F.lit(n)))
        return F.flatten(F.transform(runs, lambda run: F.when(F.length(run) >= n, cut(run)).otherwise(none)))

    found = [F.when(F.col(text) != "", F.array(F.lit(""))).otherwise(none)] if 0 in sizes else []
    found += [of_size(n) for n in sizes if n]
    return texts.withColumn("piece", F.explode(F.array_distinct(F.concat(*found)) if found else none))


def lookup_scores(asked: DataFrame, scored: DataFrame) -> DataFrame:
    """``asked`` (entity, concept, concept_id) with score and found, the step that gave it; both null if none did.

    ``scored``: entity, concept, score, seq; of a repeated pair the last holds. Under the
    entity's name, then under its name without a trailing parenthesis: the same concept
    (exact, alias exact), else the first concept whose text holds the id (id, alias id).
    Then, in the same order, the score of an entity with a single concept (only, alias only).
    """
    held = first_by(scored, ["entity", "concept"], F.col("seq").desc()).select(F.col("entity").alias("name"), F.col("concept").alias("other"), "score", "seq")
    pairs = asked.select("entity", "concept", F.col("concept_id").cast("string").alias("id")).distinct()
    said = pairs.withColumn("names", F.array_distinct(F.array("entity", entity_alias(F.col("entity"))))).select("entity", "concept", "id", F.posexplode("names").alias("turn", "name"))
    keys = ["entity", "concept", "id"]
    hit = F.struct(F.col("seq").cast("long").alias("seq"), "score")
    exact = said.join(held.withColumnRenamed("other", "concept"), ["name", "concept"]).select(*keys, (F.col("turn") * 2).alias("step"), hit.alias("hit"))
    # The first concept that holds a piece is the only one that its id can lead to.
    first = id_pieces(held, pairs).groupBy("name", F.col("piece").alias("id")).agg(F.min(hit).alias("hit"))
    by_id = said.join(first, ["name", "id"]).select(*keys, (F.col("turn") * 2 + 1).alias("step"), "hit")
    single = held.groupBy("name").agg(F.count("*").alias("n"), F.first("score").alias("score")).where("n = 1")
    alone = said.join(single, "name").select(*keys, (F.col("turn") + 4).alias("step"), F.struct(F.lit(0).cast("long").alias("seq"), "score").alias("hit"))
    best = exact.unionByName(by_id).unionByName(alone).groupBy(*keys).agg(F.min(F.struct("step", "hit")).alias("b")).select(*keys, "b.step", "b.hit.score")
    steps = F.array(*map(F.lit, ("exact", "id", "alias exact", "alias id", "only", "alias only")))
    best = best.select(F.col("entity").alias("_e"), F.col("concept").alias("_c"), F.col("id").alias("_i"), "score", F.get(steps, F.col("step")).alias("found"))
    same = F.col("entity").eqNullSafe(F.col("_e")) & F.col("concept").eqNullSafe(F.col("_c")) & F.col("concept_id").cast("string").eqNullSafe(F.col("_i"))
    return asked.join(best, same, "left").drop("_e", "_c", "_i")


def guarded_grid(cells: DataFrame, scored: DataFrame, fallback: DataFrame, disagreed: DataFrame) -> DataFrame:
    """entity, run, score of each of ``cells`` (entity, run, mapped, concept, concept_id).

    A mapped cell has the score that ``lookup_scores`` finds; where there is none, and for
    a cell that isn't mapped, that of ``fallback`` (entity, run, score) holds. But entities in
    ``disagreed`` (entity), under their name or alias, have no fallback for a mapped cell: its score is still to be decided.
    """
    found = lookup_scores(cells.where("mapped"), scored).select("entity", "run", "score", F.lit(True).alias("mapped"))
    rows = found.unionByName(cells.where("not mapped").select("entity", "run", F.lit(None).cast(found.schema["score"].dataType).alias("score"), F.lit(False).alias("mapped")))
    names = disagreed.select(F.col("entity").alias("_d")).distinct().withColumn("_open", F.lit(True))
    rows = rows.withColumn("_alias", entity_alias(F.col("entity")))
    rows = rows.join(names, F.col("entity") == F.col("_d"), "left").drop("_d").withColumnRenamed("_open", "_by_name")
    rows = rows.join(names, F.col("_alias") == F.col("_d"), "left").drop("_d")
    rows = rows.join(fallback.select("entity", "run", F.col("score").alias("_f")), ["entity", "run"], "left")
    open_ = F.col("mapped") & (F.col("_by_name").isNotNull() | F.col("_open").isNotNull())
    return rows.select("entity", "run", F.coalesce("score", F.when(~open_, F.col("_f"))).alias("score"))


def compare_three(a: Column, b: Column, c: Column) -> Column:
    """Same or Different for two or more answers, null for fewer."""
    known = F.array_compact(F.array(a, b, c))
    return F.when(F.size(known) >= 2, F.when(F.size(F.array_distinct(known)) == 1, "Same").otherwise("Different"))


#: Columns of a comparison of three systems, in order. Fixed values.
COMPARISON = (
    "source_id", "domain_id", "entity_name", "gt_concept_id", "gt_concept_name", "mapomop_concept_id", "mapomop_concept_name", "mapomop_domain", "mapomop_run_count", "mapomop_score", "omophub_concept_id", "omophub_concept_name",
    "omophub_domain", "omophub_match_score", "omophub_score", "usagi_concept_id", "usagi_concept_name", "usagi_domain", "usagi_match_score", "usagi_score", "is_same_omophub_usagi", "is_same_3models", "baseline",
)


def resolved(asked: DataFrame, name: str, records: DataFrame, entity: str, seq: str) -> DataFrame:
    """``asked`` with run_entity: the name among ``records`` that equals it, or whose alias does, or the same for its own alias; null if there is none.

    A name comes before an alias, of aliases the one that arrived first.
    """
    own = strip(F.col(entity))
    both = records.select(own.alias("run_entity"), F.col(seq).alias("_s"), F.posexplode(F.array(own, entity_alias(F.col(entity)))).alias("_turn", "_key"))
    keys = first_by(both, ["_key"], F.col("_turn").asc(), F.col("_s").asc()).select("_key", "run_entity")
    said = strip(F.col(name))
    out = asked.withColumns({"_said": said, "_short": entity_alias(F.col(name))})
    out = out.join(keys.withColumnsRenamed({"_key": "_said", "run_entity": "_one"}), "_said", "left").join(keys.withColumnsRenamed({"_key": "_short", "run_entity": "_two"}), "_short", "left")
    return out.withColumn("run_entity", F.coalesce("_one", "_two")).drop("_said", "_short", "_one", "_two")


def comparison(baseline: DataFrame, records: DataFrame, scored: DataFrame) -> DataFrame:
    """The columns ``COMPARISON``: rows of ``baseline`` beside the most frequent answer of the runs and its score.

    ``records``: entity_name, concept_id, concept_name, domain, seq, a row an answer; ``scored`` as for
    ``lookup_scores``, where concepts are written name(id). The score is looked up under the name that the runs have, then under
    the baseline's. ``baseline`` lacks the columns of the runs' system and the two verdicts.
    """
    rows = resolved(baseline, "entity_name", records, "entity_name", "seq")
    per = records.where(F.col("concept_id").isNotNull()).select(strip(F.col("entity_name")).alias("run_entity"), F.col("concept_id").cast("string").alias("mapomop_concept_id"), F.struct("concept_name", "domain").alias("meta"), "seq")
    mode = per.groupBy("run_entity", "mapomop_concept_id").agg(F.count("*").alias("mapomop_run_count"), F.min("seq").alias("_first"), F.max_by("meta", "seq").alias("meta"))
    mode = first_by(mode, ["run_entity"], F.desc("mapomop_run_count"), F.col("_first").asc())
    mode = mode.select("run_entity", "mapomop_concept_id", "mapomop_run_count", F.col("meta.concept_name").alias("mapomop_concept_name"), F.col("meta.domain").alias("mapomop_domain"))
    rows = rows.join(mode, "run_entity", "left")
    label = F.concat("mapomop_concept_name", F.lit("("), "mapomop_concept_id", F.lit(")"))
    answered = rows.where("mapomop_concept_id is not null")
    ask = lambda name: answered.select(F.col(name).alias("entity"), label.alias("concept"), F.col("mapomop_concept_id").alias("concept_id"))
    known = lookup_scores(ask("run_entity").union(ask("entity_name")).distinct(), scored).select(F.col("entity").alias("_e"), F.col("concept_id").alias("_c"), "concept", "score")
    known = known.groupBy("_e", "_c").agg(F.max_by("score", "concept").alias("score"))
    for name, out in (("run_entity", "_s1"), ("entity_name", "_s2")):
        rows = rows.join(known.withColumnRenamed("score", out), (F.col(name) == F.col("_e")) & (F.col("mapomop_concept_id") == F.col("_c")), "left").drop("_e", "_c")
    ids = [F.col(f"{x}_concept_id").cast("string") for x in ("omophub", "usagi", "mapomop")]
    rows = rows.withColumn("mapomop_score", F.coalesce("_s1", "_s2")).withColumn("is_same_omophub_usagi", compare_three(ids[0], ids[1], F.lit(None).cast("string"))).withColumn("is_same_3models", compare_three(*ids))
    return rows.select(*COMPARISON)


def alias_fan_out(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Each row under its name and its alias; of a key the last row in ``seq`` holds."""
    out = df.withColumn("key", F.explode(F.array_distinct(F.array(F.col(name), entity_alias(F.col(name))))))
    return first_by(out, ["key"], F.col(seq).desc(), F.col(name).desc())


def unpivot_runs(df: DataFrame, keys: list[str], columns: list[str], variable: str = "run", value: str = "score") -> DataFrame:
    return df.unpivot(keys, columns, variable, value)


def paired(df: DataFrame, keys: list[str], names: list[str], scores: list[str]) -> DataFrame:
    """A row for each position of interleaved name and score columns: keys, pos (from 1), name, score."""
    pairs = F.array(*(F.struct(F.col(n).alias("name"), F.col(s).alias("score")) for n, s in zip(names, scores)))
    return df.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, (F.col("pos") + 1).alias("pos"), "p.name", "p.score")


def grid(entities: DataFrame, runs: int, scores: DataFrame, fallback: DataFrame) -> DataFrame:
    """entity, run, score: each entity's score in each run, else its fallback score."""
    cells = entities.select("entity").distinct().withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    joined = cells.join(scores.withColumnRenamed("score", "_s"), ["entity", "run"], "left").join(fallback.withColumnRenamed("score", "_f"), "entity", "left")
    return joined.select("entity", "run", F.coalesce("_s", "_f").alias("score"))


def levels(df: DataFrame, group: str, domain: str, **metrics: Column) -> DataFrame:
    """The metrics over all rows, each group, and each group's domains."""
    return df.groupingSets([[], [group], [group, domain]], group, domain).agg(F.grouping_id().cast("int").alias("level"), *(m.alias(k) for k, m in metrics.items()))
