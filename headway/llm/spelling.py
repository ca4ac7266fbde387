"""Spelling variants: words at distance one, by a trie self-join with active-node sets.

The vocabulary comes from one pass over the texts.  Pairs at distance one have an edited place; the places of a word
are cut into two zones, and all words that agree outside a zone, in what stands before it (the prefix) and after it,
form a partition.  A partition with too many words, or too long a zone, is cut again in halves of its zone, whatever
the number of rounds, so no partition is larger than the limit.  In a partition the zones are a trie that is walked from its root: each node's set of
active nodes, those within distance one of it, comes from its parent's set, and where two words end in active nodes, a pair is found.

Words of n and n + 1 letters meet under the key of the shorter one, so inserted and deleted letters are found with the replaced ones.
Each pair is found in exactly one zone, that of the first place where its words differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import drop, store

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a partition; the letters of a single place are fewer, so that cutting always ends below it.
PARTITION_WORDS = 20_000
#: Places of a zone that a trie is made for.
ZONE = 32


def vocabulary(docs: DataFrame, *, least_chars: int = 5, least_count: int = 3, slip_every: int | None = 97) -> DataFrame:
    """``word, n``: the words of the texts with their numbers of occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  With ``slip_every``, a run whose
    crc32 with the document's id is a multiple of it loses one letter (a planted slip of the pen).  Null texts have no words; a null
    id counts as empty.  Shorter runs are never made into rows.
    """
    lower = F.translate(F.col("text"), _UPPER, _UPPER.lower())
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))).alias("word"),
    )
    if slip_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(h, F.length("word")).cast("int")
        slipped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % slip_every == 0, slipped).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _halves(zones: DataFrame) -> DataFrame:
    """``word, n, base, low, high``: each row twice, with the two halves of its zone of places."""
    middle = F.expr("(low + high + 1) div 2")
    half = F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("high").alias("b"))))
    return zones.select("word", "n", "base", half.alias("_")).select("word", "n", "base", F.col("_.a").cast("int").alias("low"), F.col("_.b").cast("int").alias("high")).filter("low < high")


def _keyed(zones: DataFrame) -> DataFrame:
    """Adds ``key``, what a word shares with its partition, and ``zone``, the letters between."""
    after = F.greatest(F.col("base") - F.col("high"), F.lit(0))
    size = F.length("word")
    zone = F.substring("word", F.col("low") + 1, size - F.col("low") - after)
    key = F.concat_ws("\u0000", "base", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.substring("word", size - after + 1, after))
    return zones.select("word", "n", "base", "low", "high", key.alias("key"), zone.alias("zone"))


def trie_pairs(zones: list[str], short: int, append: bool) -> Iterator[tuple[int, int]]:
    """(i, j) for each two of the distinct ``zones`` at distance one, in both orders.

    Zones have ``short`` letters or one more; two of the longer kind are left to the partitions of their own length.
    Without ``append``, a letter added behind the zone is left to the next zone.
    """
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, z in enumerate(zones):
        u = 0
        for c in z:
            if c not in children[u]:
                children[u][c] = len(children)
                children.append({})
                ends.append(-1)
            u = children[u][c]
        ends[u] = i
    if ends[0] >= 0 and append:  # the empty zone, and those of one letter
        for v in children[0].values():
            if ends[v] >= 0:
                yield ends[0], ends[v]
    todo = [(0, set(children[0].values()))]
    while todo:
        u, active = todo.pop()
        beside = children[u]
        for c, v in beside.items():
            below = children[v]
            now = {children[x][c] for x in active if c in children[x]}  # the next letter agrees
            now.update(beside.values())  # the letter is replaced
            now.discard(v)
            now.add(u)  # the letter is inserted
            now.update(below.values())  # one letter is left out
            i = ends[v]
            if i >= 0:
                for x in now:
                    j = ends[x]
                    if j < 0 or len(zones[i]) > short and len(zones[j]) > short:
                        continue
                    if append or (x != u and x not in below.values()):
                        yield i, j
            if below:
                todo.append((v, now))


def _near_in(members: list[tuple[str, str, int]], short: int, append: bool) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words here, the most frequent one, its n) of the words (zone, word, n) that have any."""
    count: dict[int, int] = {}
    best: dict[int, int] = {}
    for i, j in trie_pairs([m[0] for m in members], short, append):
        count[i] = count.get(i, 0) + 1
        k = best.get(i)
        if k is None or (-members[j][2], members[j][1]) < (-members[k][2], members[k][1]):
            best[i] = j
    for i, n in count.items():
        yield members[i][1], n, members[best[i]][1], members[best[i]][2]


def near_words(words: DataFrame, *, partition_words: int = PARTITION_WORDS, zone: int = ZONE) -> DataFrame:
    """``word, n_near, best, best_n`` of the words (``word, n``, distinct) that have words at distance one.

    ``best`` is the near word of largest n, of several the first in code-point order.  Letters are code points.
    """
    if partition_words < 100:
        raise ValueError("a partition must have room for the letters of one place")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n_near", "best", "best_n"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        at, members, head, found = None, [], (), []

        def close() -> None:
            if len(members) > 1:
                base, low, high = head
                found.extend(_near_in(members, base - low - max(base - high, 0), high > base))

        for b in batches:
            for key, *three, z, w, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != at:
                    close()
                    at, members, head = key, [], three
                members.append((z, w, n))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("base")).select("word", "n", "base", F.lit(0).alias("low"), (F.col("base") + 1).alias("high"))
    parts = []
    open_zones = _halves(whole)
    while True:
        zones = store(_keyed(open_zones), "spelling-zones")
        sizes = zones.groupBy("key").agg(F.count("*").alias("words"), F.first("low").alias("low"), F.first("high").alias("high")).filter("words > 1")
        sizes = store(sizes.select("key", ((F.col("high") - F.col("low") > 1) & ((F.col("words") > partition_words) | (F.col("high") - F.col("low") > zone))).alias("cut")), "spelling-sizes")
        ready = zones.join(sizes.filter("NOT cut").select("key"), "key", "left_semi").select("key", "base", "low", "high", "zone", "word", "n")
        parts.append(ready.repartition("key").sortWithinPartitions("key").mapInArrow(walk, "word string, n_near long, best string, best_n long"))
        if sizes.filter("cut").isEmpty():
            break
        open_zones = _halves(zones.join(sizes.filter("cut").select("key"), "key", "left_semi"))
    near = reduce(DataFrame.union, parts).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("_"))
    return near.select("word", "n_near", F.col("_.best").alias("best"), (-F.col("_.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the way word, its form, the form's form, and so on; ``forms`` has ``word, form``.

    Ways must have no cycles.  Each round doubles the steps taken, so rounds grow with the logarithm of the longest way.
    """
    at = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        met = at.join(ahead, "root", "left")
        done = store(met.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        drop(at)
        at = done
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, *, times: int = 2, partition_words: int = PARTITION_WORDS, zone: int = ZONE, **params) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the words of ``docs`` and what they are likely variants of.

    A word's form is its most frequent near word if that is at least ``times`` as frequent, else null, as its n then is; its root
    is where the forms end, the word itself without one.  Near words differ by one inserted, deleted or replaced
    letter.  Null and empty texts have no words; repeated rows count again; an empty table gives an empty
    result; other columns are ignored.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their variants")  # else ways could run in circles
    words = store(vocabulary(docs, **params), "spelling-words")
    near = near_words(words, partition_words=partition_words, zone=zone)
    fits = F.col("best_n") >= times * F.col("n")
    all_words = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    all_words = store(all_words, "spelling-forms")
    drop(words)
    ends = roots(all_words.filter("form IS NOT NULL"))
    return all_words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
