"""SentencePiece encoding and decoding; giant documents are encoded by a max-plus scan over their chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, small_batches, text_of, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A document with more code points than this is split.
GIANT = 65_536
CHUNK = 32_768
CACHED = 50_000
#: Matrices that are multiplied in one place.
FAN = 16


class Pieces:
    """A SentencePiece BPE model as a lattice.

    Text is given in the model's own form: a space mark in front and in place of every space. A segmentation is the
    model's encoding exactly if each two neighbouring pieces, encoded on their own, stay these two pieces (merges on
    both sides of a boundary go on independently until one crosses it). The encoding is thus the best path of a
    max-plus lattice in which an edge weighs 0 when it fits the edge before it and minus infinity otherwise, and
    only one path has a finite weight.
    """

    def __init__(self, model: str = MODEL):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.vocab_size())
        normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.known = {sp.id_to_piece(i): i for i in normal}
        self.longest = max(map(len, self.known))
        self.surface = [b""] * sp.vocab_size()
        for i in ids:
            if sp.is_byte(i):
                self.surface[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
            elif sp.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
        for p, i in self.known.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        inner = [p for p in self.known if len(p) > 1]
        #: A boundary lies before every space mark that follows another character, and around every line feed.
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in inner):
            raise ValueError("pieces of this model cross word boundaries")
        self.segments = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.cache: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def segment(self, s: str) -> list[int]:
        """The encoding of a stretch on its own, without a space mark being put in front."""
        if s[0] == SPACE:
            return self.sp.encode(s[1:].replace(SPACE, " ")) if len(s) > 1 else self.sp.encode("\n ")[2:]
        return self.sp.encode("\n" + s.replace(SPACE, " "))[2:]

    def stretch(self, marked: str) -> list[int]:
        """The encoding of text between two boundaries."""
        out: list[int] = []
        cache = self.cache
        for s in self.segments.findall(marked):
            if (got := cache.get(s)) is None:
                got = self.segment(s)
                if len(cache) < CACHED and len(s) < 64:
                    cache[s] = got
            out += got
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.stretch(SPACE + text.replace(" ", SPACE)) if text else [], np.int32)

    def decode(self, ids) -> str:
        out = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out

    # The lattice: edges are vocabulary pieces and, for characters that the vocabulary lacks, single characters.

    def edges(self, text: str, at: int, end: int) -> Iterator[int]:
        """Ends of the edges that start at a position."""
        for e in range(at + 1, min(at + self.longest, end) + 1):
            if e == at + 1 or text[at:e] in self.known:
                yield e

    def fits(self, left: str, right: str) -> bool:
        got = self.pairs.get((left, right))
        if got is None:
            whole, alone = self.segment(left + right), self.segment(left) + self.segment(right)
            got = whole == alone
            if len(self.pairs) < CACHED:
                self.pairs[left, right] = got
        return got

    def is_edge(self, text: str, a: int, b: int) -> bool:
        return b == a + 1 or text[a:b] in self.known

    def boundary(self, text: str, p: int) -> bool:
        return text[p] == "\n" or text[p - 1] == "\n" or (text[p] == SPACE and text[p - 1] != SPACE)

    def paths(self, text: str, begin: list[tuple[int, int]], stop: int, limit: int) -> dict[tuple[int, int], dict[int, tuple[int, int] | None]]:
        """Walks from the edges in begin. Gives for every edge that is reached, up to the first one of each path that
        ends at stop or later, from which numbers in begin it is reached (with the edge before it)."""
        reached: dict[tuple[int, int], dict[int, tuple[int, int] | None]] = {e: {i: None} for i, e in enumerate(begin)}
        ends: dict[int, list[tuple[int, int]]] = {}
        for e in begin:
            ends.setdefault(e[1], []).append(e)
        for p in range(min(ends, default=stop), stop):
            for edge in ends.pop(p, []):
                left = text[edge[0] : p] if edge[0] < p else ""
                for e in self.edges(text, p, limit):
                    if not left or self.fits(left, text[p:e]):
                        here = reached.get((p, e))
                        if here is None:
                            here = reached[p, e] = {}
                            ends.setdefault(e, []).append((p, e))
                        for i in reached[edge]:
                            here.setdefault(i, edge)
        return reached

    def crossing(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The states of a cut: edges that start before it and end at it or after it."""
        spans = [(s, e) for s in range(max(0, cut - self.longest), cut) for e in range(cut, min(len(text), s + self.longest) + 1)]
        return [x for x in spans if self.is_edge(text, *x)]

    def synced(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and the last boundary in (a, b) at a distance from the cuts; no piece crosses either."""
        inside = range(a + self.longest, b - self.longest)
        first = next((p for p in inside if self.boundary(text, p)), None)
        return None if first is None else (first, next(p for p in reversed(inside) if self.boundary(text, p)))

    def transfer(self, text: str, a: int, b: int, first: bool) -> list[tuple[int, int, int, int]]:
        """The finite entries of the transfer matrix of [a, b): a state of cut a, then a state of cut b, both as
        offsets from their cuts. text may go on beyond both cuts by the longest piece."""
        begin = [(a, a)] if first else self.crossing(text, a)
        sync = self.synced(text, a, b)
        rel = lambda s, cut: (s[0] - cut, s[1] - cut)
        if sync is None:
            reached = self.paths(text, begin, b, len(text))
            return [(*rel(begin[i], a), *rel(x, b)) for x, by in reached.items() if x[0] < b <= x[1] for i in by]
        head = self.paths(text, begin, sync[0], sync[0])
        starts = {i for x, by in head.items() if x[1] == sync[0] for i in by}
        tail = [x for x in self.paths(text, [(sync[1], sync[1])], b, len(text)) if x[0] < b <= x[1] and x[0] < x[1]]
        return [(*rel(begin[i], a), *rel(x, b)) for i in sorted(starts) for x in tail]

    def backtrace(self, text: str, a: int, b: int, enter: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """The ids of the edges after the entering one up to the leaving one, which are those of the chunk."""

        def back(reached, edge):
            out = []
            while (before := reached[edge][0]) is not None:
                out.append(text[edge[0] : edge[1]])
                edge = before
            return [i for piece in reversed(out) for i in self.segment(piece)]

        sync = self.synced(text, a, b)
        if sync is None:
            return back(self.paths(text, [enter], b, len(text)), leave)
        head = self.paths(text, [enter], sync[0], sync[0])
        last = next(x for x in head if x[1] == sync[0])
        tail = self.paths(text, [(sync[1], sync[1])], b, len(text))
        return back(head, last) + self.stretch(text[sync[0] : sync[1]]) + back(tail, leave)


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One model a Python worker."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def composed(matrices: list[set[tuple]]) -> set[tuple]:
    """The max-plus product of neighbouring chunks' matrices: their finite entries (entering state, leaving state)."""
    out = matrices[0]
    for m in matrices[1:]:
        after: dict[tuple, list[tuple]] = {}
        for x in m:
            after.setdefault(x[:2], []).append(x[2:])
        out = {x[:2] + y for x in out for y in after.get(x[2:], ())}
    return out


def parted(matrices: list[set[tuple]], enter: tuple, leave: tuple) -> list[tuple[tuple, tuple]]:
    """The states at the cuts inside a product's chunks, given those at its ends: (enter, leave) of each chunk."""
    alive = [{enter}]
    for m in matrices:
        alive.append({x[2:] for x in m if x[:2] in alive[-1]})
    out = []
    for m, before in zip(reversed(matrices), reversed(alive[:-1])):
        begin = next(x[:2] for x in m if x[2:] == leave and x[:2] in before)
        out.append((begin, leave))
        leave = begin
    return out[::-1]


def _packed(entries: set[tuple]) -> np.ndarray:
    return np.array(sorted(entries), np.int32).reshape(-1)


def _unpacked(column: pd.Series) -> list[set[tuple]]:
    return [set(map(tuple, e.reshape(-1, 4).tolist())) for e in column]


def _states(found: DataFrame, fan: int = FAN) -> DataFrame:
    """(key, k, enter, leave): the piece over either cut of every chunk, from the matrices (key, k, entries) of all.

    `fan` neighbouring matrices are multiplied into one, round after round, until one is left for each text, which
    tells its last state. On the way back every product hands the states at its ends to its parts. No group has more
    than `fan` rows, however long a text is.
    """

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "k": [key[1]], "entries": [_packed(composed(_unpacked(rows.sort_values("k")["entries"])))]})

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ends = [next(x for x in m if x[3] == 0) for m in _unpacked(rows["entries"])]
            yield pd.DataFrame({"key": rows["key"], "k": rows["k"], "enter": [list(x[:2]) for x in ends], "leave": [list(x[2:]) for x in ends]})

    def inside(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        states = parted(_unpacked(rows["entries"]), tuple(rows["enter"].iloc[0].tolist()), tuple(rows["leave"].iloc[0].tolist()))
        return pd.DataFrame({"key": key[0], "k": rows["k"], "enter": [list(x) for x, _ in states], "leave": [list(x) for _, x in states]})

    block = (F.col("k") / fan).cast("int")
    levels, most = [found], found.agg(F.max("k")).first()[0]
    while most:
        levels.append(written(levels[-1].groupBy("key", block.alias("block")).applyInPandas(product, "key string, k int, entries array<int>"), "pieces-products"))
        most //= fan
    schema = "key string, k int, enter array<int>, leave array<int>"
    states = levels.pop().mapInPandas(last, schema)
    for level in reversed(levels):
        ends = states.select("key", F.col("k").alias("block"), "enter", "leave")
        states = level.withColumn("block", block).join(ends, ["key", "block"]).groupBy("key", "block").applyInPandas(inside, schema)
    return states


def _chunks(giants: DataFrame, model_longest: int) -> DataFrame:
    """One row a chunk: its text with a margin on both sides, and where the chunk lies in it."""
    size = F.length("__marked")
    cut = F.col("k") * CHUNK
    rows = giants.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(size / CHUNK).cast("int") - 1))).withColumn("__size", size)
    left = F.least(cut, F.lit(model_longest + 1))
    right = F.least(cut + CHUNK, F.col("__size"))
    return rows.withColumn("a", left).withColumn("b", right - cut + left).withColumn(
        "part", F.expr(f"substring(`__marked`, k * {CHUNK} - a + 1, b + {model_longest})")
    ).drop("__marked", "__size")


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, longest: int = 16) -> DataFrame:
    """Adds the ids of the model's encoding, array<int>, to every row.

    Documents of up to GIANT code points are encoded where they are. A longer one is split into chunks of CHUNK
    code points, dealt to tasks; each gives the matrix from the pieces that may cross its left cut to those that
    may cross its right cut. The matrices of a text are multiplied in rounds, a few neighbours at a time, which fixes the
    piece over every cut, and each chunk is traced back on its own. Equal giant texts are encoded once. longest is at least the length of the
    longest piece.

    Defined cases: null and empty texts have no ids; the results are those of the SentencePiece library; repeated
    rows get equal ids; an empty table gives an empty result. An input column named like ids_col is replaced.
    """
    carried = Carried(df)
    rows = df.select(*carried.hide(df), text_of(text_col).alias("__text"))
    hidden = [F.col(c) for c in carried.private]

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = pieces(model)
        for texts in batches:
            yield pd.Series([p.encode(t) for t in texts])

    short = rows.where(F.length("__text") <= GIANT).select(*hidden, ids("__text").alias("__ids"))

    giants = rows.where(F.length("__text") > GIANT).withColumn("__key", F.sha2("__text", 256))
    marked = F.concat(F.lit(SPACE), F.replace("__text", F.lit(" "), F.lit(SPACE)))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for batch in batches:
            for key, k, a, b, part in batch[["__key", "k", "a", "b", "part"]].itertuples(index=False):
                entries = p.transfer(part, a, b, k == 0)
                yield pd.DataFrame({"key": [key], "k": [k], "entries": [np.array(entries, np.int32).reshape(-1)]})

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for batch in batches:
            for r in batch.itertuples(index=False):
                enter, leave = (r.enter[0] + r.a, r.enter[1] + r.a), (r.leave[0] + r.b, r.leave[1] + r.b)
                yield pd.DataFrame({"key": [r.key], "k": [r.k], "ids": [np.array(p.backtrace(r.part, r.a, r.b, enter, leave), np.int32)]})

    once = giants.groupBy("__key").agg(F.first("__text").alias("__text"))
    parts = written(_chunks(once.select("__key", marked.alias("__marked")), longest), "pieces-chunks")
    found = written(parts.mapInPandas(matrices, "key string, k int, entries array<int>"), "pieces-matrices")
    known = parts.withColumnRenamed("__key", "key").join(_states(found), ["key", "k"])
    spelled = known.mapInPandas(traced, "key string, k int, ids array<int>").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("all"))
    spelled = spelled.select("key", F.flatten("all.ids").alias("__ids"))
    long = giants.join(spelled, F.col("__key") == F.col("key")).select(*hidden, "__ids")
    return short.unionByName(long).select(*carried.show([ids_col]), F.col("__ids").alias(ids_col))


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Adds the text that ids spell, replacing a column named text_col. Null or no ids give the empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = pieces(model)
        for rows in batches:
            yield pd.Series([p.decode(r.tolist()) if r is not None else "" for r in rows], dtype=object)

    carried = Carried(df)
    rows = df.select(*carried.hide(df), text(F.col(ids_col)).alias("__text"))
    return rows.select(*carried.show([text_col]), F.col("__text").alias(text_col))


def coded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as decimal numbers with single spaces), decoded_sha256, round_trip."""
    source = docs.select("doc_id", text_of("text").alias("source_text"))
    both = decode(encode(source, "source_text", model=model), model=model)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"), (F.col("text") == F.col("source_text")).alias("round_trip"),
    )


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
