"""Exact Jaccard join on word n-grams, with set relations used to skip work.

Documents with equal sets are one class.  Sets are indexed by their first tokens in one global order (rare tokens
by hash, frequent ones last), so that sets that link share an indexed token.  Index lists are cut into blocks by size
class, and an entry is skipped whose position leaves too few tokens.

Answers are shared between similar sets.  In every list a few leaders stand for the rest: each set is compared with the
leader it shares most tokens with, which joins most of a group of copies without its pairs.  Only pairs across the
components found are looked at further, and there the overlap with a set y is derived from its leader x:
``|y & z| = |x & z| - |(x \\ y) & z| + |(y \\ x) & z|``, so that a leader's answer is computed once and each follower's
from the few tokens it differs in.  No pair that may link is left out: what the leaders do not settle is compared.

Defined cases: null and empty texts have an empty set and are linked with nothing.  A document without an id is linked
like any other but cannot name a component.  Rows with one id are one document only if their sets are equal.
Repeated rows are all returned.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWERED, light, mapped, raw, to_arrow, unused, written
from .components import components

GRAM, PERCENT = 5, 80
FREQUENT = 16                # an indexed token of more sets than this moves to the end of the order
ORDERED = 1 << 18            # so many of the most frequent tokens at most are held by each task; it bounds memory, not results
LEADERS, ROUNDS = 8, 3
BITS = 512                   # bits of a set's parity map
KNOWN = 1 << 18              # words whose hash a worker keeps
KEY = ["n", "sa", "sb"]

_words: dict[bytes, int] = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def shingles(data: bytes, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text; of fewer words, the whole sequence is one."""
    words = data.translate(LOWERED).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _words
    if len(known) > KNOWN:
        known.clear()
    hashed = [known.get(w) for w in words]
    if None in hashed:
        hashed = [h if h is not None else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w, h in zip(words, hashed, strict=True)]
    values, size = np.array(hashed, np.uint64), min(gram, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out = mixed(out * _ODD + values[i:i + count])
    return np.unique(out)


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """Smallest overlap with which a set of this size can link."""
    return -(-percent * size // 100)


def indexed(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set, so many that sets that link share one of them."""
    if len(frequent) and len(tokens):
        late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        tokens = np.concatenate([tokens[~late], tokens[late]])
    return tokens[:len(tokens) - least_overlap(len(tokens), percent) + 1] if len(tokens) else tokens


def parity(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity map of a set: each token flips one bit.

    Tokens of both sets cancel, so two maps differ in no more bits than the sets in tokens: half of both sizes
    less the differing bits is never under the overlap.
    """
    flips = np.bincount((mixed(tokens + np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.int64)


def forget() -> None:
    """Drop the word hashes kept by this worker."""
    _words.clear()


def _signed(value: np.ndarray) -> list[int]:
    return np.asarray(value, np.uint64).view(np.int64).tolist()


def sets(docs: DataFrame, frequent: np.ndarray, gram: int = GRAM, percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """doc_id, size and signature of the set of every row, with its indexed tokens or the whole set."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)       # of bounded size

    def step(batch: pa.RecordBatch) -> dict:
        own, late = [shingles(x, gram) for x in raw(batch)], held.value
        mark = lambda salt: _signed(np.array([mixed(s + np.uint64(salt)).sum(dtype=np.uint64) for s in own], np.uint64))
        last = {"data": [s.tobytes() for s in own]} if whole else {
            "tokens": [indexed(s, late, percent).view(np.int64) for s in own], "bits": [parity(s) for s in own]}
        return {"doc_id": batch.column("doc_id"), "n": [len(s) for s in own], "sa": mark(1), "sb": mark(2)} | last

    return mapped(docs.select("doc_id", "text"), step, "doc_id long, n long, sa long, sb long, " + ("data binary" if whole else "tokens array<long>, bits array<long>"), forget)


def class_of(marks: DataFrame) -> DataFrame:
    """Classes of equal sets: key, cls, smallest id, how many rows have that id, and the parity map."""
    by_id = marks.where("n > 0").groupBy(*KEY, "doc_id").agg(F.count("*").alias("copies"), F.first("bits").alias("bits"))
    low = F.min_by(F.struct("doc_id", "copies", "bits"), F.struct(F.col("doc_id").isNull(), "doc_id"))
    return written(by_id.groupBy(*KEY).agg(low.alias("one"))
                   .select(F.monotonically_increasing_id().alias("cls"), *KEY, F.col("one.doc_id").alias("low"), F.col("one.copies").alias("copies"), "one.bits"))


def _first_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the documents that stand for their class, with cls and copies."""
    named = light(classes.select("cls", "copies", F.col("low").alias("_low"), *(F.col(k).alias(f"_{k}") for k in KEY)))
    same = [F.col(k) == F.col(f"_{k}") for k in KEY]
    return rows.join(named, [*same, F.col("doc_id").eqNullSafe(F.col("_low"))]).drop("_low", *(f"_{k}" for k in KEY))


def frequent_tokens(marks: DataFrame, classes: DataFrame) -> np.ndarray:
    """Sorted tokens that many classes have among their indexed ones."""
    many = written(_first_rows(marks, classes).select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > FREQUENT))
    rows = many.orderBy(F.desc("count"), "token").limit(ORDERED).collect()       # a top list of bounded length
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def index_lists(docs: DataFrame, classes: DataFrame, frequent: np.ndarray, gram: int, percent: int) -> DataFrame:
    """token, cls, n, pos of all tokens that two or more classes are indexed by, with the leaders of each list."""
    own = _first_rows(sets(docs, frequent, gram, percent).where("n > 0"), classes).select("cls", "n", "tokens", "copies")
    own = own.where("copies = 1").unionByName(own.where("copies > 1").dropDuplicates(["cls"])) if classes.where("copies > 1").head(1) else own
    one_list = Window.partitionBy("token")
    heads = [F.min_by(F.struct("cls", "n"), F.xxhash64("cls", F.lit(seed), F.pmod("token", F.lit(LEADERS)))).over(one_list) for seed in range(ROUNDS)]
    entries = own.select("cls", "n", F.posexplode("tokens").alias("pos", "token"))
    return written(entries.select("token", "cls", "n", "pos", F.count("*").over(one_list).alias("many"), F.array(*heads).alias("heads"))
                   .where("many > 1").drop("many"))


def may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes allow a link."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def enough(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether an overlap is enough for a link: 100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * (a + b)


def fetched(docs: DataFrame, classes: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """cls, n and the whole set of the classes in ``wanted``."""
    own = written(classes.join(wanted.distinct(), "cls", "left_semi"))
    near = docs.select("doc_id", "text").join(light(own.select(F.col("low").alias("doc_id"))), "doc_id", "left_semi")
    nameless = docs.select("doc_id", "text").where("doc_id IS NULL") if own.where("low IS NULL").head(1) else None
    found = sets(near if nameless is None else near.unionByName(nameless), np.zeros(0, np.uint64), gram, whole=True)
    return written(found.join(own, KEY).select("cls", "n", "data").where(F.length("data") > 0))


def compared(pairs: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y with their link, and in what y differs from x."""
    def step(batch: pa.RecordBatch) -> dict:
        link, gone, new = [], [], []
        for a, b in zip(raw(batch, "data_x"), raw(batch, "data_y"), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            shared = a[at] == b
            size = int(shared.sum())
            ok = 100 * size >= percent * (len(a) + len(b) - size)
            link.append(ok)
            lost = np.ones(len(a), bool)
            lost[at[shared]] = False
            gone.append(a[lost].tobytes() if ok else None)
            new.append(b[~shared].tobytes() if ok else None)
        return {"x": batch.column("x"), "y": batch.column("y"), "link": link, "gone": gone, "new": new}

    named = lambda s: stored.select(F.col("cls").alias(s), F.col("data").alias(f"data_{s}"))
    rows = pairs.select("x", "y").join(named("x"), "x").join(named("y"), "y")
    return mapped(rows, step, "x long, y long, link boolean, gone binary, new binary")


def derived(pairs: DataFrame, stored: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs y, z that link; the overlap of a y that has a leader is derived from the leader's overlap."""
    form = to_arrow("y long, z long")

    def run(batches):
        last, overlap, x, z = None, 0, None, None
        for batch in batches:
            ys, zs, keep = batch.column("y").to_pylist(), batch.column("z").to_pylist(), []
            xs, column = batch.column("x").to_pylist(), {c: batch.column(c) for c in ("data_x", "data_z", "gone", "new")}
            for i, pair in enumerate(zip(xs, zs, strict=True)):
                if pair != last:
                    last, x, z = pair, np.frombuffer(column["data_x"][i].as_py(), np.uint64), np.frombuffer(column["data_z"][i].as_py(), np.uint64)
                    overlap = within(x, z)
                gone, new = (np.frombuffer(column[c][i].as_py() or b"", np.uint64) for c in ("gone", "new"))
                size = len(x) - len(gone) + len(new)
                linked = lambda both, size=size: 100 * both >= percent * (size + len(z) - both)
                if linked(overlap - len(gone)):
                    keep.append(True)
                elif not linked(overlap + len(new)):
                    keep.append(False)
                else:
                    keep.append(linked(overlap - within(gone, z) + within(new, z)))
            yield pa.RecordBatch.from_arrays([pa.array([y for y, k in zip(ys, keep, strict=True) if k], pa.int64()),
                                              pa.array([w for w, k in zip(zs, keep, strict=True) if k], pa.int64())], schema=form)

    named = lambda s: stored.select(F.col("cls").alias(s), F.col("data").alias(f"data_{s}"))
    rows = (pairs.join(leaders.select("y", "x", "gone", "new"), "y", "left").withColumn("x", F.coalesce("x", "y"))
            .join(named("x"), "x").join(named("z"), "z"))
    return rows.sortWithinPartitions("x", "z").mapInArrow(run, "y long, z long")


def within(few: np.ndarray, many: np.ndarray) -> int:
    """How many sorted tokens of ``few`` are in ``many``."""
    if not len(few) or not len(many):
        return 0
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` with the component of each class so far."""
    if comps is None:
        return rows.withColumn("comp", F.col("cls"))
    return rows.join(light(comps.select(F.col("node").alias("cls"), F.col("comp").alias("_comp"))), "cls", "left").withColumn("comp", F.coalesce("_comp", "cls")).drop("_comp")


def _apart(a: str, b: str) -> Column:
    """In how many bits two parity maps differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def led(lists: DataFrame, classes: DataFrame, comps: DataFrame | None, seed: int, percent: int) -> DataFrame:
    """For every class the nearest leader by parity map, of those in other components that it may link with."""
    head = F.col("heads")[seed]
    met = lists.select(head["cls"].alias("x"), head["n"].alias("n_x"), "cls", "n").where((F.col("x") != F.col("cls")) & may_link(F.col("n"), F.col("n_x"), percent))
    met = met.groupBy("x", "cls").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("n_x").alias("n_x"))
    few = (100 - percent) * F.col("n") / (400 * LEADERS)        # a quarter of what copies share; the rest is left to the pairs
    met = met.where(F.col("shared") >= few)
    if comps is not None:
        met = _labelled(_labelled(met, comps).withColumnRenamed("comp", "comp_y").withColumnsRenamed({"cls": "y", "x": "cls"}), comps)
        met = met.where("comp <> comp_y").withColumnsRenamed({"cls": "x", "y": "cls"})
    maps = lambda name: classes.select(F.col("cls").alias(name), F.col("bits").alias(f"bits_{name}"))
    met = met.join(maps("cls"), "cls").join(maps("x"), "x").withColumn("apart", _apart("bits_cls", "bits_x"))
    near = met.where(enough((F.col("n") + F.col("n_x") - F.col("apart")) / 2, F.col("n"), F.col("n_x"), percent))
    return near.groupBy(F.col("cls").alias("y")).agg(F.max_by("x", F.struct(-F.col("apart"), "x")).alias("x")).select("x", "y")


def crossing(lists: DataFrame, classes: DataFrame, comps: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of classes of different components that may still link, by index blocks of one token and size class.

    An entry is skipped whose position leaves too few tokens, or whose parity map differs in too many bits.
    """
    one_list = Window.partitionBy("token")
    rows = _labelled(lists.drop("heads"), comps)
    rows = written(rows.withColumn("low", F.min("comp").over(one_list)).withColumn("high", F.max("comp").over(one_list)).where("low < high"))
    maps = classes.join(light(rows.select("cls").distinct()), "cls", "left_semi").select("cls", "bits")
    rows = rows.join(maps, "cls").withColumn("block", F.floor(F.log(F.col("n")) / F.log(F.lit(1.02 * 100 / percent))).cast("int"))
    small = rows.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1))).select(
        "token", "block", *(F.col(c).alias(f"{c}_y") for c in ("cls", "n", "pos", "comp", "bits")))
    large = rows.select("token", "block", *(F.col(c).alias(f"{c}_z") for c in ("cls", "n", "pos", "comp", "bits")))
    apart = _apart("bits_y", "bits_z")
    left = F.least(F.col("n_y") - F.col("pos_y"), F.col("n_z") - F.col("pos_z"))
    ordered = (F.col("n_y") < F.col("n_z")) | ((F.col("n_y") == F.col("n_z")) & (F.col("cls_y") < F.col("cls_z")))
    met = (small.join(large, ["token", "block"])
           .where((F.col("comp_y") != F.col("comp_z")) & ordered & may_link(F.col("n_y"), F.col("n_z"), percent)
                  & enough(left, F.col("n_y"), F.col("n_z"), percent)
                  & enough((F.col("n_y") + F.col("n_z") - apart) / 2, F.col("n_y"), F.col("n_z"), percent))
           .groupBy(F.col("cls_y").alias("y"), F.col("cls_z").alias("z"), "n_y", "n_z", "comp_y", "comp_z")
           .agg(F.count("*").alias("shared"), F.max("pos_y").alias("pos_y"), F.max("pos_z").alias("pos_z")))
    rest = F.least(F.col("n_y") - F.col("pos_y"), F.col("n_z") - F.col("pos_z")) - 1
    return met.where(enough(F.col("shared") + rest, F.col("n_y"), F.col("n_z"), percent))


def link(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    marks = written(sets(docs, np.zeros(0, np.uint64), gram, percent))
    classes = class_of(marks)
    lists = index_lists(docs, classes, frequent_tokens(marks, classes), gram, percent)
    comps, edges, leaders, stored = None, None, None, None
    for seed in range(rounds):
        pairs = written(led(lists, classes, comps, seed, percent))
        if not pairs.head(1):
            break
        ends = pairs.select(F.explode(F.array("x", "y")).alias("cls"))
        stored = _with(stored, docs, classes, ends, gram)
        found = written(compared(pairs, stored, percent).where("link").distinct())
        leaders = found if leaders is None else leaders.unionByName(found)
        edges = _joined(edges, found.select(F.col("x").alias("a"), F.col("y").alias("b")))
        comps = written(components(edges))
    kind = "y long, x long, gone binary, new binary"
    leaders = (docs.sparkSession.createDataFrame([], kind) if leaders is None
               else written(leaders.groupBy("y").agg(F.min_by(F.struct("x", "gone", "new"), F.length("gone") + F.length("new")).alias("b")).select("y", "b.x", "b.gone", "b.new")))
    open_pairs = written(crossing(lists, classes, comps, percent))
    if open_pairs.head(1):
        likely = Window.partitionBy(F.least("comp_y", "comp_z"), F.greatest("comp_y", "comp_z")).orderBy(F.desc("shared"), "y", "z")
        first = open_pairs.withColumn("rank", F.row_number().over(likely)).where("rank <= 2").select("y", "z")
        stored = _with(stored, docs, classes, _ends(first, leaders), gram)
        found = written(derived(first, stored, leaders, percent))
        edges = _joined(edges, found.select(F.col("y").alias("a"), F.col("z").alias("b")))
        comps = written(components(edges))
        rest = open_pairs.join(first, ["y", "z"], "left_anti").select("y", "z")
        for end in ("y", "z"):
            rest = _labelled(rest.withColumnRenamed(end, "cls"), comps).withColumnRenamed("cls", end).withColumnRenamed("comp", f"comp_{end}")
        rest = written(rest.where("comp_y <> comp_z").select("y", "z"))
        if rest.head(1):
            stored = _with(stored, docs, classes, _ends(rest, leaders), gram)
            found = written(derived(rest, stored, leaders, percent))
            comps = written(components(_joined(edges, found.select(F.col("y").alias("a"), F.col("z").alias("b")))))
    named = _labelled(classes.select("cls", *KEY, "low"), comps)
    names = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(names, "comp").select(*KEY, "component_id")
    linked = marks.select("doc_id", *KEY).where("n > 0").join(named, KEY).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = marks.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _ends(pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """Classes whose sets are needed to decide ``pairs``."""
    heads = pairs.join(leaders.select("y", "x"), "y", "left").select(F.coalesce("x", "y").alias("cls"))
    return heads.unionByName(pairs.select(F.col("z").alias("cls")))


def _with(stored: DataFrame | None, docs: DataFrame, classes: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """The stored sets and those still missing of ``wanted``."""
    if stored is None:
        return fetched(docs, classes, wanted, gram)
    missing = written(wanted.distinct().join(stored.select("cls"), "cls", "left_anti"))
    return stored.unionByName(fetched(docs, classes, missing, gram)) if missing.head(1) else stored


def _joined(edges: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if edges is None else edges.unionByName(new)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group; rows without an id stay."""
    name = unused(docs.columns, "_id")
    stay = link(docs).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, docs["doc_id"] == F.col(name), "left_semi").unionByName(docs.where("doc_id IS NULL"))
