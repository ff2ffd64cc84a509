"""N-gram Jaccard join by signature trees: exact components of documents whose sets of 5-word shingles have a Jaccard
similarity of 0.8 or more.

1. Every text becomes the hash of its shingle set; equal sets are one set from here on (grouped, combined before the
   exchange).
2. A set that links with another one has at least 80 % of its tokens in it. So a set of which fewer than 80 % of the
   tokens occur in any other set links with nothing. Tokens are counted in buckets of their hash, packed as bytes; tokens
   that are frequent within a task are settled there and sent on as two entries, so no bucket holds a hot token's sets.
3. The sets left exchange their rarest tokens only (a set with n tokens: as many that a partner can't miss all of them;
   tokens of no other set count as met by nobody). Sets that share such a token, however indirectly, form a block;
   links never leave a block.
4. A signature tree finds the components inside each block. Small blocks share a task; a large one is cut into chunks.
   Chunks are first joined in themselves, then by one set of each component. Only sets that still share a rare token with
   a set of another component are then compared over all pairs of chunks, and dual traversal skips what is joined.

Defined cases: null and empty texts have no shingles and link with nothing; a text of fewer than five words has its whole
sequence as its one shingle; repeated rows are copies; rows with a null doc_id link with nothing and have a null component;
empty tables give empty results; extra columns are ignored, `representatives` passes them through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostride.llm import bloom
from geostride.llm.graph import components
from geostride.llm.memory import released, released_group
from geostride.llm.shingles import set_hash, shingle_sets
from geostride.llm.signature_tree import Tree
from geostride.llm.skew import join_facts
from geostride.llm.tokens import slices
from geostride.session import discard, materialize, ship, table

PERCENT = 80
#: Sets and tokens of a chunk, and tokens of a bucket: what a task holds at once.
CHUNK_SETS, CHUNK_TOKENS, BUCKET_TOKENS = 2000, 2_000_000, 2_000_000
#: Buckets and bins at least, so that the work spreads over a cluster.
LEAST_TASKS = 64
#: A token of so many sets of one slice is settled inside its task.
FREQUENT = 16
SLICE_CHARS = 500_000
#: Bytes of a token's hash that are sent (with the bucket's number they tell tokens apart).
WIDTH = 5


def set_table(docs: DataFrame, key: str = "doc_id", text: str = "text", texts_too: bool = False) -> DataFrame:
    """(key, n, s): size and hash of each text's shingle set, s null where it is empty or the key is null; if asked for,
    the text too."""
    names_of = ["key", "n", "s", *(["text"] if texts_too else [])]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                sets = shingle_sets(texts[a:b])
                keys = batch.column(0).slice(a, b - a)
                names = [set_hash(x) if len(x) and k is not None else None for k, x in zip(keys.to_pylist(), sets, strict=True)]
                own = [pa.array(texts[a:b], pa.string())] if texts_too else []
                yield pa.record_batch([keys, pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.int64()), *own], names_of)

    schema = "key long, n long, s long" + (", text string" if texts_too else "")
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(released(hashed), schema)


def _pack(name: np.ndarray, counts: np.ndarray, tokens: np.ndarray, known: np.ndarray) -> bytes:
    return struct.pack("<III", len(name), len(tokens), len(known)) + name.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes() + known.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sets of the tokens, tokens, (set, count) pairs settled in the sending task)."""
    a, b, c = struct.unpack_from("<III", blob)
    name, counts = np.frombuffer(blob, "<i8", a, 12), np.frombuffer(blob, "<u4", a, 12 + 8 * a)
    wide = np.zeros((b, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(blob, np.uint8, b * WIDTH, 12 + 12 * a).reshape(b, WIDTH)
    return np.repeat(name, counts), wide.view("<u8").ravel(), np.frombuffer(blob, "<i8", 2 * c, 12 + 12 * a + b * WIDTH).reshape(-1, 2)


def _bucket_blobs(sets: list[np.ndarray], names: list[int], buckets: int) -> Iterator[tuple[int, bytes]]:
    """The tokens of distinct sets by bucket. Frequent tokens go as two entries; the other sets that hold them get their
    counts from here."""
    if not sets:
        return
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    sorted_ = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    size = np.diff(np.concatenate([first, [len(sorted_)]]))
    place = np.arange(len(sorted_)) - np.repeat(first, size)
    settled = np.zeros(len(tokens), bool)
    settled[order] = (np.repeat(size, size) >= FREQUENT) & (place >= 2)
    known = np.bincount(owner[settled], minlength=len(sets))
    tokens, owner = tokens[~settled], owner[~settled]
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    rest = tokens // np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    bucket, rest, owner = bucket[by], rest[by], owner[by]
    names_ = np.array(names, np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    sent = np.flatnonzero(known)
    for k in range(buckets):
        a, b = cuts[k], cuts[k + 1]
        own = sent[sent % buckets == k] if len(sent) else sent
        if a == b and not len(own):
            continue
        o = owner[a:b]
        head = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if b > a else np.zeros(0, int)
        yield k, _pack(names_[o[head]], np.diff(np.concatenate([head, [b - a]])), rest[a:b], np.stack([names_[own], known[own]], 1).astype("<i8"))


def shared_counts(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """(s, shared): how many tokens of each set occur in another set, for sets with any."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets this task has sent; only to send less
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                sets, names = [], []
                for x in shingle_sets(texts[a:b]):
                    if len(x) and (s := set_hash(x)) not in seen:
                        seen.add(s)
                        sets.append(x)
                        names.append(s)
                if len(seen) > 1_000_000:
                    seen = set()
                for k, blob in _bucket_blobs(sets, names, buckets):
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in frame["blob"]]
        names, tokens = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        known = np.concatenate([p[2] for p in parts])
        order = np.argsort(tokens, kind="stable")
        names, tokens = names[order], tokens[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        # a token is shared if its entries name more than one set; of a set's entries for one token one counts
        differs = np.logical_or.reduceat(names != names[first][np.cumsum(new) - 1], first) if len(first) else np.zeros(0, bool)
        shared = np.repeat(differs, np.diff(np.concatenate([first, [len(tokens)]])))
        pairs = pd.DataFrame({"s": names[shared], "t": tokens[shared]}).drop_duplicates()
        out = pairs.groupby("s").size().rename("shared").reset_index()
        settled = pd.DataFrame({"s": known[:, 0], "shared": known[:, 1]})
        return pd.concat([out, settled]).astype("i8")

    blobs = docs.select(text).mapInArrow(released(sent), "bucket int, blob binary")
    return blobs.groupBy("bucket").applyInPandas(released_group(counted), "s long, shared long").groupBy("s").agg(F.sum("shared").alias("shared"))


def token_sets(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(s, n, tokens) of the chosen (s, rep), one row a set. A filter of fixed size lets the texts of the chosen keys
    through to be cut into tokens; then only tokens, not texts, are dealt out for the exact join."""
    lets_through = bloom.build(chosen.select("rep"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(known & bloom.may_hold(lets_through, keys.fill_null(0).to_numpy(zero_copy_only=False)))
            texts = batch.column(1).take(pa.array(at)).to_pylist()
            own = keys.take(pa.array(at))
            for a, b in slices(texts, SLICE_CHARS):
                sets = shingle_sets(texts[a:b])
                yield pa.record_batch([own.slice(a, b - a), pa.array([set_hash(x) if len(x) else None for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["rep", "s", "n", "tokens"])

    cut = docs.select(F.col(key).cast("long").alias("rep"), F.col(text)).mapInArrow(released(taken), "rep long, s long, n long, tokens array<long>")
    # rows that share a key may differ in text, so both have to agree; dealt by s, which the last step needs as well
    exact = cut.join(chosen.withColumnRenamed("rep", "own"), "s").filter("rep = own")
    return exact.select("s", "n", "tokens").dropDuplicates(["s"])


def rare_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(token, s): the rarest tokens of each set of which a linked set can't miss all, without those of no other set."""
    held = sets.select("s", "n", F.explode("tokens").alias("token"))
    counts = materialize(held.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1"), "ngram-counts")
    shared = join_facts(held, counts.withColumn("f", F.col("held")), "token", "s")
    by_rarity = Window.partitionBy("s").orderBy("f", "token")
    ranked = shared.withColumn("rank", F.row_number().over(by_rarity)).withColumn("shared", F.count("*").over(Window.partitionBy("s")))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # the n - shared tokens of no other set come first in the order
    return ranked.filter(F.col("rank") + F.col("n") - F.col("shared") <= most).select("token", "s")


def _tree_task(percent: int, with_labels: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("block", sort=False):
            if len(part) < 2:
                continue
            s = part["s"].to_numpy()
            order = np.argsort(s, kind="stable")
            s = s[order]
            sets = [np.asarray(x, np.int64).view(np.uint64) for x in part["tokens"].to_numpy()[order]]
            least = Tree(sets, part["label"].to_numpy()[order] if with_labels else None, percent).link()
            moved = np.flatnonzero(least != np.arange(len(s)))
            out.append(pd.DataFrame({"a": s[moved], "b": s[least[moved]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, "i8"), "b": np.zeros(0, "i8")})

    return run


def _chunks(blocks: DataFrame) -> DataFrame:
    """blocks: (s, n, block). Adds of (chunks of the block) and chunk."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("_g"), F.sum("n").alias("_t"))
    of = F.greatest(F.ceil(F.col("_g") / CHUNK_SETS), F.ceil(F.col("_t") / CHUNK_TOKENS)).cast("int")
    joined = blocks.join(sizes.select("block", of.alias("of"), "_g"), "block")
    return joined.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "s"), "of").cast("int"))


def _run_trees(parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """parts: (s, block, chunk, of, _g). Linked (a, b) inside each chunk; small blocks share tasks."""
    small = F.col("_g") <= 64
    bins = max(LEAST_TASKS, int(sets.count() // 2000))
    parts = parts.withColumn("t0", F.when(small, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.col("block"))).withColumn("t1", F.when(small, -1).otherwise(F.col("chunk")))
    fed = parts.join(sets.select("s", "tokens"), "s").select("t0", "t1", "block", "s", "tokens")
    return materialize(fed.groupBy("t0", "t1").applyInPandas(released_group(_tree_task(percent, False)), "a long, b long"), "ngram-links")


def link_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sets: (s, n, tokens), written. (s, component) of the sets that link with another one."""
    rare = materialize(rare_tokens(sets, percent), "ngram-rare")
    least = rare.groupBy("token").agg(F.min("s").alias("least"), F.max("s").alias("most"), F.count("*").alias("held")).filter("least < most")
    least = materialize(least.select("token", "least", "held"), "ngram-least")
    stars = join_facts(rare, least, "token", "s").filter("s <> least").select(F.col("s").alias("a"), F.col("least").alias("b"))
    blocks = components(stars).withColumnsRenamed({"node": "s", "component": "block"})
    parts = materialize(_chunks(blocks.join(sets.select("s", "n"), "s")), "ngram-parts")
    edges = _run_trees(parts, sets, percent)
    large = parts.filter("of > 1")
    if large.isEmpty():
        found = components(edges)
        discard(rare, least, parts, edges)
        return found.withColumnRenamed("node", "s")
    # one set of each component of a chunk stands for it
    joined = large.select("s", "n", "block").join(edges.select(F.col("a").alias("s")), "s", "left_anti")
    edges = edges.union(_run_trees(materialize(_chunks(joined), "ngram-parts"), sets, percent))
    labels = components(edges).withColumnsRenamed({"node": "s", "component": "label"})
    labelled = materialize(large.select("s", "n", "block").join(labels, "s", "left").withColumn("label", F.coalesce("label", "s")), "ngram-labelled")
    met = rare.join(labelled.select("s", "label"), "s")
    mixed = met.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("held")).filter("x < y")
    open_ = join_facts(met, materialize(mixed.select("token", "held"), "ngram-mixed"), "token", "s").select("s").distinct()
    rest = materialize(_chunks(labelled.join(open_, "s")), "ngram-open")
    if not rest.isEmpty():
        every = F.sequence(F.lit(0), F.col("of") - 1)
        pairs = F.transform(every, lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j")))
        fed = rest.withColumn("p", F.explode(pairs)).join(sets.select("s", "tokens"), "s").select("block", "p.i", "p.j", "s", "label", "tokens")
        edges = edges.union(materialize(fed.groupBy("block", "i", "j").applyInPandas(released_group(_tree_task(percent, True)), "a long, b long"), "ngram-links"))
    found = components(edges)
    discard(rare, least, parts, labelled, rest)
    return found.withColumnRenamed("node", "s")


def _set_components(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(key, n, s, component_id) of every row."""
    ship(docs.sparkSession)
    facts = materialize(set_table(docs, key, text), "ngram-sets")
    distinct = materialize(facts.filter("s is not null").groupBy("s").agg(F.first("n").alias("n"), F.min("key").alias("rep")), "ngram-distinct")
    # of all rows, not of distinct sets: a task sends each of its sets once, but copies may lie in every task
    total = facts.filter("s is not null").agg(F.sum("n").alias("t")).first()["t"] or 0
    buckets = max(LEAST_TASKS, total // BUCKET_TOKENS)
    shared = shared_counts(docs, int(buckets), text)
    may_link = F.col("shared") >= F.ceil(F.col("n") * percent / 100)
    chosen = materialize(distinct.join(shared, "s").filter(may_link).select("s", "rep"), "ngram-chosen")
    sets = materialize(token_sets(docs, chosen, key, text), "ngram-tokens")
    linked = link_components(sets, percent)
    reps = distinct.join(linked.withColumnRenamed("component", "c"), "s", "left").withColumn("c", F.coalesce("c", "s"))
    named = reps.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_set = materialize(reps.join(named, "c").select(F.col("s").alias("set"), "component_id"), "ngram-components")
    discard(distinct, chosen, sets)
    out = facts.filter("s is not null").join(by_set, F.col("s") == F.col("set")).select("key", "n", "s", "component_id")
    return out.union(facts.filter("s is null").select("key", "n", "s", F.col("key").alias("component_id")))


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    return _set_components(docs, key, text, percent).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with one of each component: the one with the smallest key; of rows that repeat a key and a text one
    stays. Rows without a key, a text or words stay. Where rows repeat a key with other texts, each goes by its own text."""
    facts = materialize(_set_components(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", percent), "ngram-facts")
    copies = facts.filter("key <> component_id")
    dropped = materialize(copies.select(F.col("key").alias("_dropped")).distinct(), "ngram-dropped")
    repeated = materialize(facts.groupBy("key").count().filter("count > 1 and key is not null").select(F.col("key").alias("_repeated")), "ngram-repeated")
    if repeated.isEmpty():
        return docs.join(dropped, F.col(key) == F.col("_dropped"), "left_anti")
    again = docs.join(repeated, F.col(key) == F.col("_repeated"), "left_semi")
    sets = set_table(again, key, text, texts_too=True).filter("s is not null")
    linked = sets.join(copies.select("key", "s").distinct(), ["key", "s"], "left_semi").select(F.col("key").alias("_key"), F.col("text").alias("_text")).distinct()
    linked = materialize(linked, "ngram-linked")
    once = again.join(linked, (F.col(key) == F.col("_key")) & (F.col(text) == F.col("_text")), "left_anti").dropDuplicates([key, text])
    alone = docs.join(repeated, F.col(key) == F.col("_repeated"), "left_anti")
    return alone.join(dropped, F.col(key) == F.col("_dropped"), "left_anti").unionByName(once)


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same components in DuckDB: every pair of documents that shares a shingle is counted.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN least ON least.a = doc_id
"""
