"""Documents that hold passages of a benchmark, by spaced-seed hashing.

A seed mask is laid over every run of words; only the words under its ones are
hashed, so a substituted word under a zero costs nothing. Hashes of documents and
of benchmark items are joined. Around each hit the words of document and item are
compared, over every run of ``window`` words of the item that holds the hit; a pair
counts if one has at least ``similarity`` of its words equal. Items shorter than
that are compared whole.

Words are the runs of letters and digits of the lower-cased text. All is
whole-stage compiled; documents are never shuffled, only verified hits are. The
benchmark's seeds are broadcast in blocks of at most ``most_seeds``.

Defined cases: null and empty texts match nothing, nor do items of fewer than five
words; items between that and ``window`` are also hashed whole, in as many ways that
some way has blanks wherever words may be substituted. A
result row stands for a (doc_id, item_id); repeated rows fall together, and null ids
form an id of their own. Columns besides id and text are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight 5; of 15 words with three substituted these miss one in a few hundred.
MASKS = ("1101011", "11100101")
FEWEST = 5
#: Seeds of the benchmark in a broadcast; each row also holds its item's words.
MOST_SEEDS = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _seed(mask: str, tokens: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(tokens, at + F.lit(i)) for i, bit in enumerate(mask) if bit == "1"))


def whole_masks(n: int, blanks: int) -> list[str]:
    """Masks of ``n`` places: wherever ``blanks`` words are substituted, one of them has none under a one.

    The places are dealt in two blocks more than that, and any ``blanks`` blocks are left out.
    """
    parts = min(n, blanks + 2)
    block = [i * parts // n for i in range(n)]
    return ["".join("0" if b in out else "1" for b in block) for out in combinations(range(parts), blanks)]


def _places(shortest: int) -> Column:
    """The places of a row of words ``w`` that a mask may start at."""
    last = F.size("w") - shortest
    return F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most_seeds: int = MOST_SEEDS) -> DataFrame:
    """doc_id, item_id, the most equal words of a window (best), its length (of), and the first word of a hit (first_word)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("item_w")).withColumn("item_n", F.size("item_w")).where(F.col("item_n") >= FEWEST)
    lengths = sorted(r.item_n for r in items.where(F.col("item_n") <= window).select("item_n").distinct().collect())  # a few lengths at most
    masks = [(m, F.lit(True)) for m in MASKS]
    masks += [(m, F.col("item_n") == n) for n in lengths for m in whole_masks(n, int((1 - similarity) * n + 1e-9))]
    shortest = min(len(m) for m, _ in masks)
    seeds = items.withColumn("w", F.col("item_w")).withColumn("j", _places(shortest))
    made = [F.when((F.col("j") + len(m) <= F.col("item_n")) & fit, F.struct(_seed(m, F.col("w"), F.col("j")).alias("seed"), F.lit(len(m)).alias("span"))) for m, fit in masks]
    seeds = seeds.withColumn("s", F.explode(F.array(*made))).where("s is not null").select("item_id", "item_w", "item_n", "j", "s.seed", "s.span")

    def hashed(m: str) -> Column:
        seed = _seed(m, F.col("w"), F.col("p"))
        return seed if m.endswith("1") else F.when(F.col("p") + len(m) <= F.size("w"), seed)

    # A document's hash over its end covers fewer words, so no item's seed equals it; the comparison below would not let it pass either.
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).select("doc_id", "w", _places(shortest).alias("p"))
    rows = rows.select("doc_id", "w", "p", F.explode(F.array(*(hashed(m) for m, _ in masks))).alias("seed"))
    blocks = -(-seeds.count() // most_seeds) or 1  # a pass over the documents for each block of the benchmark's seeds
    parts = [rows.join(F.broadcast(seeds.where(F.pmod("seed", F.lit(blocks)) == b) if blocks > 1 else seeds), "seed") for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, parts)

    of = F.least(F.lit(window), F.col("item_n"))
    at = F.col("p") - F.col("j")  # item word k lies over document word at + k

    def equal(start: Column) -> Column:
        # A loop rather than 13 terms: those would make the generated method too long for the JVM to compile, and all rows slow.
        return F.aggregate(F.sequence(F.lit(0), of - 1), F.lit(0), lambda n, k: n + F.when(F.get("w", at + start + k) == F.get("item_w", start + k), 1).otherwise(0))

    starts = F.sequence(F.greatest(F.lit(0), F.col("j") + F.col("span") - of), F.least(F.col("j"), F.col("item_n") - of))
    # Generated, so that the comparison neither enters the join's condition nor its compiled loop.
    hits = hits.withColumn("best", F.explode(F.array(F.array_max(F.transform(starts, equal))))).withColumn("of", of)
    enough = F.lit(similarity) * F.col("of") <= F.col("best") + F.lit(1e-9)
    return hits.where(enough).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"), F.max("of").alias("of"), F.min("p").alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame, most_ids: int = 1_000_000, **options) -> DataFrame:
    """The rows of ``docs`` without a match, judged by id and text; a null doc_id stays.

    The rows found are broadcast up to ``most_ids`` and joined by shuffle beyond.
    """
    from termweave.llm import store

    row = F.struct(F.col("doc_id"), F.xxhash64(F.col("text")))
    named = docs.where("doc_id is not null").select(row.alias("doc_id"), "text")
    found = store.materialize(matches(named, benchmark, **options).select(F.col("doc_id").alias("_leaked")).distinct(), "leaks")
    found = F.broadcast(found) if found.count() <= most_ids else found
    return docs.join(found, row == F.col("_leaked"), "left_anti")
