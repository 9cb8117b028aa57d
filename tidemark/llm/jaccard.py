"""Exact n-gram Jaccard join by prefix filters under several global token orders.

A document's tokens are the hashes of its distinct n-word shingles.  Two documents with a Jaccard
similarity of at least t share a token among the first floor((1 - t) n) + 1 of each under any
global order of tokens, and in fact many of them; so a pair must pass under every order used.

Orders, all of which a pair must pass before its texts are compared:

1. Tokens of one document only come first.  A document with more of them than it may differ in shares no prefix token
   with anybody and is done with; that is most of a corpus without its copies, so only the rest is dealt out token by token.
   Tokens are counted by 32 + bits bits of their hash in 2**bits buckets (a rule like any other), packed by unit of rows and bucket.
2. Of a fixed share of all tokens (by hash) those in few documents come first, the rest follow by hash.  These prefixes are joined.
3. Another hash: candidates need enough common prefix tokens under it as well.

Only components are wanted, so pairs within one component are never formed.  Where more than
``SMALL`` members of a token group are outside its largest component, the group isn't paired up: all its
members are compared with one of them, the hub (the one that is in most such groups; groups that meet share one).  Those that
link to it become one component.  For others a counting argument holds: x links to y, not both
linked to the hub, only if both differ from the hub in common tokens, and in one among a prefix of the difference
under an order that puts the hub's own tokens last and rare ones first.  So the group is
dealt anew by hub and differing token; what is still large after ``LEVELS`` rounds is paired up.  A token's place in a prefix
bounds the size of what the document can link to through it, so before members are counted or paired, those that
reach no member of another component leave the group.

Members of a hub go to it as whole texts, since they need their differences in any case; all other pairs pass the three orders.

Linked documents get the least id of their component.  Equal token sets link without comparison.

Edge cases: a null or empty text has no tokens and links with nothing; fewer words than n make one
shingle; rows that repeat an id are compared row by row, like any others; null ids come before all
ids, a component with one has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._frames import by_bucket, cut, drop_tables, key_or, packed, utf8
from tidemark.llm._text import U64, Words, inside, mix, ngrams, signed, slices
from tidemark.llm.components import components

#: Members of a token group that may be paired with each other.
SMALL = 32
#: How often a large group is dealt anew before what is left of it is paired up.
LEVELS = 2
#: Tokens whose numbers of documents are counted for the first order: this many times the share of a prefix.
POOL = 1.25
#: Bits of the filter that spares most texts without candidates a shuffle; a fixed size, and only a filter.
FILTER_BITS = 1 << 27
NONE = -(1 << 63)


def token_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): the distinct tokens of some texts, in order, and where each text's begin."""
    w = Words([t.lower() for t in texts])
    words, own = w.hashes(), w.owner()
    at = inside(w.first, w.per_text, n)
    owners, tokens = [own[at]], [ngrams(words, n)[at]]
    for m in range(1, n):  # shorter texts
        few = np.flatnonzero(w.per_text == m)
        if len(few):
            owners.append(few)
            tokens.append(ngrams(words, m)[w.first[few]])
    own, tok = np.concatenate(owners), np.concatenate(tokens)
    order = np.lexsort((tok, own))
    own, tok = own[order], tok[order]
    if len(own):
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (tok[1:] != tok[:-1])
        own, tok = own[new], tok[new]
    return tok, np.searchsorted(own, np.arange(len(texts) + 1))


def order_key(tok: np.ndarray, which: int) -> np.ndarray:
    """The place of tokens in the hash order number ``which``."""
    return mix(tok + U64(0x9E3779B97F4A7C15 * (which + 1) % (1 << 64)))


def prefix(key: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, first) of each text's tokens with the least keys, as many as ``lengths`` says."""
    sizes = np.diff(first)
    order = np.lexsort((key, np.repeat(np.arange(len(sizes)), sizes)))
    take = np.minimum(sizes, lengths)
    rank = np.arange(len(key)) - np.repeat(first[:-1], sizes)
    return order[rank < np.repeat(take, sizes)], np.concatenate(([0], np.cumsum(take)))


#: Bytes of text whose tokens are counted in one bucket, about.
BUCKET_BYTES = 6 << 20
#: Of a document: unit and place in it are r; of a unit and bucket: singles (tokens of one document of the unit), their documents (places, as steps), others.
_SIGN = "r bigint, k bigint, x bigint, n bigint, d1 bigint, d2 bigint, pooled int, p1 array<bigint>, p2 array<int>, unit bigint, bucket int, singles binary, owners binary, others binary"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
_SIGN_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split(" ") for f in _SIGN.split(", "))])


def _only(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of the named columns, all others null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _SIGN_SCHEMA], schema=_SIGN_SCHEMA)


def _steps(places: np.ndarray) -> bytes:
    return np.diff(places, prepend=0).astype(np.uint16).tobytes()


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint16), dtype=np.int64)


def _packed(unit: int, tok: np.ndarray, own: np.ndarray, bits: int) -> pa.RecordBatch | None:
    """A unit's tokens by bucket, from tokens in the order of their documents."""
    key = tok >> U64(32 - bits)
    order = np.argsort(key)
    key_in_order = key[order]
    same = key_in_order[1:] == key_in_order[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    single = np.zeros(len(key), bool)
    single[order[~twice]] = True
    more = np.unique(key_in_order[twice])
    at = np.flatnonzero(single)
    at = at[np.argsort((key[at] >> U64(32)).astype(np.uint32), kind="stable")]
    of_single, of_more = key[at] >> U64(32), more >> U64(32)
    used = np.union1d(of_single, of_more)
    if not len(used):
        return None
    cut_at = lambda of, values: [values[i:j] for i, j in zip(np.searchsorted(of, used), np.searchsorted(of, used, "right"), strict=True)]
    return _only({
        "unit": pa.array(np.full(len(used), unit)), "bucket": pa.array(used.astype(np.int32)),
        "singles": pa.array([x.tobytes() for x in cut_at(of_single, key[at].astype(np.uint32))], pa.binary()),
        "owners": pa.array([_steps(x) for x in cut_at(of_single, own[at])], pa.binary()),
        "others": pa.array([x.tobytes() for x in cut_at(of_more, more.astype(np.uint32))], pa.binary()),
    })


def _sign(n: int, percent: int, bits: int):
    """Over rows (k, x, t, part): a row per document and one per bucket of its unit (a batch), see _SIGN."""
    limit = U64(int(min(0.99, POOL * (100 - percent) / 100) * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        for b in batches:
            if not b.num_rows:
                continue
            unit = b.column(3)[0].as_py() << 20 if unit is None else unit + 1
            texts, seen = b.column(2).to_pylist(), set()
            columns, lists, tokens, owners = [[] for _ in range(4)], ([], []), [], []
            for i, j in slices(texts):
                tok, first = token_sets(texts[i:j], n)
                sizes = np.diff(first)
                sums = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(tok ^ U64(c)))))[first] for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                d1, d2 = (np.diff(x) for x in sums)
                copy = np.zeros(j - i, bool)  # the batch has an equal set already
                for m, t in enumerate(zip(d1.tolist(), d2.tolist(), sizes.tolist(), strict=True)):
                    copy[m] = t in seen
                    seen.add(t)
                length = np.where(copy, 0, (100 - percent) * sizes // 100 + 1)
                key = order_key(tok, 0)
                inner = np.concatenate(([0], np.cumsum(key < limit)))[first]
                pooled = np.where(copy, 0, np.diff(inner))
                at, bounds = prefix(key, first, np.where(copy, 0, np.maximum(pooled, length)))
                lists[0].append((signed(tok[at]), np.diff(bounds)))
                at, bounds = prefix(order_key(tok, 1), first, length)
                lists[1].append(((mix(tok[at]) >> U64(32)).astype(np.uint32).view(np.int32), np.diff(bounds)))
                for column, v in zip(columns, (sizes, signed(d1), signed(d2), pooled.astype(np.int32)), strict=True):
                    column.append(v)
                tokens.append(tok)
                owners.append(np.repeat(np.arange(i, j), sizes))
            made = {"r": pa.array((unit << 16) + np.arange(b.num_rows)), "k": b.column(0), "x": b.column(1)} | {c: pa.array(np.concatenate(v)) for c, v in zip(("n", "d1", "d2", "pooled"), columns, strict=True)}
            for c, parts, kind in zip(("p1", "p2"), lists, (pa.int64(), pa.int32()), strict=True):
                ends = np.concatenate(([0], np.cumsum(np.concatenate([q[1] for q in parts])))).astype(np.int32)
                made[c] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([q[0] for q in parts]), kind))
            yield _only(made)
            if (packed := _packed(unit, np.concatenate(tokens), np.concatenate(owners), bits)) is not None:
                yield packed

    return run


def _alone(asked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Of one bucket: per unit, the places of the documents of its tokens that no other document has."""
    key = np.concatenate([s for _, s, _, _ in asked])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    single = np.ones(len(key), bool)
    single[order[1:][same]] = False
    single[order[:-1][same]] = False
    more = np.unique(np.concatenate([o for _, _, _, o in asked]))
    if len(more):
        single &= more[np.minimum(np.searchsorted(more, key), len(more) - 1)] != key
    ends = np.cumsum([len(s) for _, s, _, _ in asked])
    told = [(u, _steps(own[single[end - len(s) : end]])) for (u, s, own, _), end in zip(asked, ends, strict=True)]
    return _only({"unit": pa.array([u for u, t in told if t], pa.int64()), "owners": pa.array([t for _, t in told if t], pa.binary())})


def _count_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows of _SIGN in the order of buckets: documents' rows pass, a bucket's rows become those of _alone."""
    at, asked = None, []
    for b in batches:
        of_bucket = pc.is_valid(b.column("bucket"))
        if (passed := b.filter(pc.invert(of_bucket))).num_rows:
            yield passed
        for unit, bucket, singles, owners, others in zip(*(b.filter(of_bucket).column(c).to_pylist() for c in ("unit", "bucket", "singles", "owners", "others")), strict=True):
            if at is not None and bucket != at:
                yield _alone(asked)
                asked = []
            at = bucket
            asked.append((unit, np.frombuffer(singles, np.uint32), _places(owners), np.frombuffer(others, np.uint32)))
    if asked:
        yield _alone(asked)


def _sum_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (unit, owners) in the order of units: (r, alone), the number of tokens that only the document has."""
    at, count = None, np.zeros(0, np.int64)

    def told() -> pa.RecordBatch:
        own = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array((at << 16) + own), pa.array(count[own])], names=["r", "alone"])

    for b in batches:
        for unit, owners in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if unit != at:
                if at is not None:
                    yield told()
                at, count = unit, np.zeros(1 << 16, np.int64)
            np.add.at(count, _places(owners), 1)
    if at is not None:
        yield told()


def _apart(size: int, n: int, linked: bool, percent: int) -> int:
    """How many tokens of its difference from a hub (size of it) a document with n tokens may not share with what it links to, beside the hub's links.

    All but (1 - t) n / t are shared; if it links to the hub itself, a share of t / 2 at least.
    """
    return size - (percent * size + 199) // 200 if linked else (100 - percent) * n // percent


def _compare(n: int, percent: int, deltas: bool):
    """Over rows (a, b, ta, tb): links by exact comparison; with ``deltas`` the groups to deal b to next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            out = ([], [], [], [], [], [], [])
            for i, j in slices(tb):
                hubs: dict[bytes, int] = {}
                hub = [hubs.setdefault(ta[m].as_py(), len(hubs)) for m in range(i, j)]
                atok, afirst = token_sets(list(hubs), n)
                btok, bfirst = token_sets([tb[m].as_py() for m in range(i, j)], n)
                for m in range(j - i):
                    x, y = atok[afirst[hub[m]] : afirst[hub[m] + 1]], btok[bfirst[m] : bfirst[m + 1]]
                    if not len(x) or not len(y):
                        continue
                    every = np.concatenate((x, y))
                    every.sort()
                    same = every[1:] == every[:-1]
                    common = int(same.sum())
                    linked = 100 * common >= percent * (len(x) + len(y) - common)
                    row, own, size = np.zeros(0, np.int64), 0, 0
                    if deltas:
                        alone = np.ones(len(every), bool)
                        alone[1:] &= ~same
                        alone[:-1] &= ~same
                        d = every[alone]
                        of_hub = np.isin(d, x, assume_unique=True)
                        own, size = int((~of_hub).sum()), len(d)
                        # the hub's own come last, so few of them can be among the first
                        row = np.concatenate((d[~of_hub], d[of_hub][: max(0, _apart(size, len(y), linked, percent) + 1 - own)]))
                        row = signed(mix(row ^ mix(np.array([a[i + m]]).view(U64))))
                    if linked or deltas:
                        for o, v in zip(out, (int(a[i + m]), int(b[i + m]), linked, row, own, size, len(y)), strict=True):
                            o.append(v)
            ends = np.concatenate(([0], np.cumsum([len(r) for r in out[3]]))).astype(np.int32)
            flat = np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32()), pa.array(out[6], pa.int64())],
                names=["a", "b", "linked", "next", "own", "size", "n"],
            )

    return run


_FOUND = "a bigint, b bigint, linked boolean, next array<bigint>, own int, size int, n bigint"


def _bit(k: Column) -> Column:
    return F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))


def _texts_for(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(r, t) for the rows (r, k, x) of ``wanted``."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(k), {FILTER_BITS}) % 64 as int))")
    words = wanted.groupBy(F.floor(_bit(F.col("k")) / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = keyed.sparkSession.sparkContext.broadcast(bits.view(U64))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(3).to_numpy()
            keep = (shared.value[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
            yield b.filter(pa.array(keep)).select([0, 1, 2])

    some = keyed.select("k", "x", "t", _bit(F.col("k")).alias("place")).mapInArrow(likely, "k bigint, x bigint, t binary")
    found = some.join(wanted, ["k", "x"])
    return by_bucket(found, "texts", "r", lambda dealt: dealt.groupBy("r").agg(F.first("t").alias("t")))


def _compared(pairs: DataFrame, texts: DataFrame, n: int, percent: int, deltas: bool, name: str) -> DataFrame:
    """_compare() for pairs (a, b): only the pairs and the texts in them move, as ``texts`` lies in buckets."""
    b = texts.select(F.col("r").alias("b"), F.col("t").alias("tb"))
    # written, as a hub's pairs can be split among tasks only if both sides are dealt out anew
    a = cut(texts.join(pairs.select(F.col("a").alias("r")).distinct(), "r", "left_semi").select(F.col("r").alias("a"), F.col("t").alias("ta")), "hubs")
    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    out = cut(both.mapInArrow(_compare(n, percent, deltas), _FOUND), name)
    drop_tables(pairs.sparkSession, a)
    return out


def _first_groups(signs: DataFrame, percent: int) -> DataFrame:
    """(token, k, n, pos): the prefixes under the second order, as far as others may share their tokens."""
    rows = signs.select("r", "n", "pooled", F.posexplode("p1").alias("at", "token"))
    part = F.expr("cast(shiftright(token, 32) as int)")  # counts by half of the token's bits: a rule like any other
    often = rows.groupBy(part.alias("part")).agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.withColumn("part", part).join(often, "part")
    rows = rows.withColumn("late", F.col("at") >= F.col("pooled"))
    own = Window.partitionBy("r", "late")
    before = F.col("pooled") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1
    rows = rows.withColumn("pos", F.when(F.col("late"), F.col("at")).otherwise(before).cast("int"))
    return rows.where(F.col("pos") <= F.floor((100 - percent) * F.col("n") / 100)).select("token", F.col("r").alias("k"), "n", "pos")


def _with_partners(rows: DataFrame) -> DataFrame:
    """Of rows (token, c, s, reach, ...) those that may find a partner: of another component, within reach and reaching them.

    Of a token's largest component only what an outsider can reach stays, however many members it has.
    """
    parts = rows.groupBy("token", "c").agg(F.count("*").alias("m"), F.min("s").alias("s"), F.max("reach").alias("reach"))
    of = parts.groupBy("token").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.min("s").alias("least"), F.max("reach").alias("most"))
    out = parts.join(of, "token").where("c <> main").groupBy("token", "main", "least", "most").agg(F.min("s").alias("least_out"), F.max("reach").alias("most_out"))
    j = rows.join(out, "token")
    inner = F.col("c") == F.col("main")
    least, most = F.when(inner, F.col("least_out")).otherwise(F.col("least")), F.when(inner, F.col("most_out")).otherwise(F.col("most"))
    return j.where((F.col("reach") >= least) & (F.col("s") <= most)).select(*rows.columns)


def _hubs(large: DataFrame) -> DataFrame:
    """(a, b): each member b of a large group with the document a that the group is compared with.

    Of a group that is the member in most large groups, its hub.  A hub that is itself a member of another hub's groups gives its
    groups to the one of these with most members, so that a document is compared and dealt once for the groups of its likes:
    the counting argument holds for any document that all members of a group are compared with.
    """
    often = large.groupBy("k").agg(F.count("*").alias("groups"))
    hubs = large.join(often, "k").groupBy("token").agg(F.max(F.struct("groups", (-F.col("pos")).alias("early"), (-F.col("k")).alias("k"))).alias("hub"))
    member = cut(large.join(hubs, "token").select((-F.col("hub.k")).alias("hub"), F.col("k").alias("b")).distinct(), "members")
    size = member.groupBy("hub").agg(F.count("*").alias("size"))
    over = member.join(size, "hub").join(size.select(F.col("hub").alias("b")), "b")
    over = over.groupBy(F.col("b").alias("hub")).agg(F.max(F.struct("size", (-F.col("hub")).alias("hub"))).alias("over"))
    star = cut(member.join(over, "hub").select((-F.col("over.hub")).alias("a"), "b").where("a <> b").distinct(), "star")
    drop_tables(large.sparkSession, member)
    return star


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and broadcasts of what nobody refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _signatures(keyed: DataFrame, n: int, percent: int) -> DataFrame:
    """The documents' rows and the buckets' replies, see _SIGN; a document moves as its tokens' keys and prefixes."""
    size = keyed.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = min(30, max(3, (size // BUCKET_BYTES).bit_length()))
    signs = keyed.withColumn("part", F.spark_partition_id()).mapInArrow(_sign(n, percent, bits), _SIGN)
    dealt = signs.repartition(F.when(F.col("bucket").isNull(), F.xxhash64("r")).otherwise(F.xxhash64("bucket"))).sortWithinPartitions("bucket")
    return cut(dealt.mapInArrow(_count_alone, _SIGN), "signatures")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(k, x, n_shingles, component) per row of docs: its id and text hash, its tokens and the least id it reaches.

    Null ids are the least bigint.
    """
    spark = docs.sparkSession
    text = F.coalesce(utf8(docs[f"`{text_col}`"]), F.lit(b""))
    keyed = docs.select(key_or(docs[f"`{id_col}`"]).alias("k"), F.xxhash64(text).alias("x"), text.alias("t"))
    told = _signatures(keyed, n, percent)
    signs = told.where("r is not null")
    narrow = cut(signs.select("r", "k", "x", "n", "d1", "d2"), "rows")
    whole = narrow.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("r").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    twins = narrow.join(whole.select("d1", "d2", "n", "first"), ["d1", "d2", "n"]).where("r <> first")
    links = cut(twins.select(F.col("first").alias("a"), F.col("r").alias("b")), "twins")

    # the first order: documents with no more tokens of their own than they may differ in
    alone = told.where("r is null").select("unit", "owners").repartition("unit").sortWithinPartitions("unit").mapInArrow(_sum_alone, "r bigint, alone bigint")
    open_ = narrow.where("n > 0").join(alone, "r", "left").where(F.coalesce("alone", F.lit(0)) <= F.floor((100 - percent) * F.col("n") / 100))
    open_ = open_.select("r").join(links.select(F.col("b").alias("r")), "r", "left_anti")
    signs = cut(signs.select("r", "n", "pooled", "p1", "p2").join(open_, "r", "left_semi"), "open")
    drop_tables(spark, told)

    every = cut(_first_groups(signs, percent), "prefixes")
    wanted = every.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    rows = cut(every.join(wanted, "token"), "prefixes")
    drop_tables(spark, every)
    wanted = rows.select(F.col("k").alias("r")).distinct().join(narrow.select("r", "k", "x"), "r")
    texts = _texts_for(keyed, wanted)
    label, pairs = None, None
    for level in range(LEVELS + 1):
        if label is None:
            shared = rows.withColumn("c", F.col("k"))
        else:
            often = rows.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
            shared = cut(rows.join(often, "token"), "groups")
        # a member's first common token with what it links to has at least as many tokens after it as they must share: that bounds the other's size
        if label is None:
            size, reach = F.col("n"), F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent + 1e-6) - F.col("n")
        else:
            size, reach = F.col("size"), F.col("size") - 2 * F.col("pos") + F.floor((100 - percent) * F.col("n") / percent)
        shared = shared.withColumn("s", size.cast("bigint")).withColumn("reach", reach.cast("bigint"))
        met = cut(_with_partners(shared), "groups")
        drop_tables(spark, rows, shared)
        # of what is left: members outside the group's largest component; all pairs across components have one
        by = met.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "c")).alias("main"), F.sum("m").alias("members"))
        by = by.where("members > main.m").select("token", F.col("main.c").alias("main"), (F.col("members") - F.col("main.m")).alias("others"))
        group = cut(met.join(by, "token"), "groups")
        drop_tables(spark, met)
        last = level == LEVELS
        small = group if last else group.where(F.col("others") <= SMALL)
        x = small.where("c <> main").select("token", "main", F.col("k").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("s").alias("sa"), F.col("reach").alias("ra"))
        y = small.select("token", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("s").alias("sb"), F.col("reach").alias("rb"))
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))  # two outsiders meet once
        fits = (F.col("ra") >= F.col("sb")) & (F.col("rb") >= F.col("sa"))
        p = x.join(y, "token").where((F.col("ca") != F.col("cb")) & fits & near & once)
        p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        p = cut(p, "pairs")
        pairs = p if pairs is None else pairs.unionByName(p)
        large = group.where(F.col("others") > SMALL)
        if last or large.isEmpty():
            drop_tables(spark, group)
            break
        star = _hubs(large)
        found = _compared(star, texts, n, percent, True, "stars")
        drop_tables(spark, group, star)
        links = links.unionByName(cut(found.where("linked").select("a", "b"), "twins"))
        label = components(links)
        # hubs that all link to need no more; of a difference from another hub, the prefix is dealt out
        open_ = found.where("not linked").select("a").distinct()
        dealt = found.join(open_, "a", "left_semi").join(label, F.col("b") == F.col("v"), "left").withColumn("c", F.coalesce("label", "b"))
        dealt = dealt.repartition("b", "a")  # a hub's documents evenly, before their differences are dealt out
        dealt = dealt.select("a", "b", "c", "n", "own", "size", "linked", F.posexplode("next").alias("at", "token"))
        dealt = dealt.join(dealt.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token").withColumn("late", F.col("at") >= F.col("own"))
        own = Window.partitionBy("a", "b", "late")
        # tokens of one difference come first, then rare ones; the hub's own follow in the order of their hashes
        rank = F.when(F.col("late"), F.col("at")).otherwise(F.col("own") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1)
        apart = F.when(F.col("linked"), F.col("size") - F.ceil(percent * F.col("size") / 200)).otherwise(F.floor((100 - percent) * F.col("n") / percent))
        dealt = dealt.withColumn("pos", rank).where(F.col("pos") <= apart)
        rows = dealt.select("token", F.col("b").alias("k"), "n", "pos", "c", "size")
        rows = cut(rows, "dealt")
        drop_tables(spark, found)

    # the third order, before texts are compared
    pairs = pairs.distinct()
    pre = signs.join(pairs.select(F.col("a").alias("r")).union(pairs.select("b")).distinct(), "r", "left_semi").select("r", "n", "p2")
    pre_a, pre_b = (pre.select(F.col("r").alias(c), F.col("n").alias(f"m{c}"), F.col("p2").alias(f"p{c}")) for c in "ab")
    q = pairs.join(pre_b, "b").join(pre_a, "a")
    length = lambda c: F.floor((100 - percent) * F.col(c) / 100) + 1
    need = F.ceil(percent * (F.col("ma") + F.col("mb")) / (100 + percent) - 1e-9)
    least = F.greatest(F.lit(1), F.least(need - F.col("ma") + length("ma"), need - F.col("mb") + length("mb")))
    hidden = length("ma") - F.size(F.array_distinct("pa")) + length("mb") - F.size(F.array_distinct("pb"))
    q = cut(q.where(F.size(F.array_intersect("pa", "pb")) + hidden >= least).select("a", "b"), "candidates")
    drop_tables(spark, signs)
    checked = _compared(q, texts, n, percent, False, "links").where("linked").select("a", "b")
    drop_tables(spark, texts)

    label = components(checked.unionByName(links))
    _release(spark)
    least_id = label.join(narrow.select("r", "k"), F.col("v") == F.col("r")).groupBy(F.col("label").alias("l")).agg(F.min("k").alias("component"))
    out = narrow.join(label, F.col("r") == F.col("v"), "left").join(least_id, F.col("label") == F.col("l"), "left")
    return out.select("k", "x", F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component"))


def op7(documents: DataFrame) -> DataFrame:
    found = similarity_components(documents.select("doc_id", "text"))
    null = lambda c: F.when(F.col(c) != F.lit(NONE), F.col(c))
    return found.select(null("k").alias("doc_id"), "n_shingles", null("component").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the one with the least id, then text hash; all columns stay.

    Equal rows of the same id stay or go together.
    """
    found = similarity_components(docs, n=n, percent=percent).where("n_shingles > 0")
    # of the rows with a component's least id one text stays
    stay = found.where("k = component").groupBy("component").agg(F.min("x").alias("stays"))
    gone = found.join(stay, "component").where("k <> component or x <> stays").select("k", "x").distinct()
    row, unpacked = packed(docs)
    keyed = docs.select(key_or(docs["doc_id"]).alias("k"), F.xxhash64(F.coalesce(utf8(docs["text"]), F.lit(b""))).alias("x"), row)
    return keyed.join(gone, ["k", "x"], "left_anti").select(*unpacked())


#: Links by shared shingles, components by recursion; small tables only.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS u(i)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)),
r(v, m) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v WHERE r.m < l.b)
SELECT w.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(least(min(r.m), w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN r ON r.v = w.doc_id GROUP BY w.doc_id, z.n
"""
