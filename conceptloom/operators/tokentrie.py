"""Tries of token sequences as sorted Arrow tables in the shared folder.

The names of a group are sequences of token ids with an end, sorted and cut into segments of bounded size: an Arrow file
each, with all ids in one buffer. A prefix is a range of rows of each segment and is narrowed by binary search, so a
trie takes four bytes a token and no object a node. On a folder of the local file system segments are memory-mapped and
shared by the workers of a machine; elsewhere they are read once a worker.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Ids of the end of a name, of `<+>` between two names, and of the separator after the last; token ids start at FIRST.
END, PLUS, SEP, FIRST = 0, 1, 2, 16
#: Names of a segment, at most.
SEGMENT_ROWS = 1 << 18
#: Ranges from this many rows on keep the ids that may follow.
WIDE = 1 << 12


def hashed_words(entity: Column) -> Column:
    """Token ids of a name without a vocabulary file: 28 bits of the MD5 of each word, an end after the last."""
    words = F.transform(F.split(entity, " "), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint") + FIRST).cast("int"))
    return F.concat(words, F.array(F.lit(END)))


def vocabulary(df: DataFrame, path: str) -> Callable[[Column], Column]:
    """Token ids by a file of the `tokenizers` library on the driver, moved up by FIRST, an end after the last."""
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    made: dict[str, object] = {}

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        if "t" not in made:
            made["t"] = Tokenizer.from_str(shared.value)
        encoded = [[*(i + FIRST for i in e.ids), END] for e in made["t"].encode_batch([t or "" for t in text.to_pylist()], add_special_tokens=False)]
        return pa.array(encoded, pa.list_(pa.int32()))

    return ids


Range = tuple[int, int, int]
#: A place in a trie: ranges of rows (segment, first, end) that begin alike, and how many tokens they share.
Place = tuple[tuple[Range, ...], int]


class Choices:
    """The sorted ids that may follow at a place, and what scorers have made of them: orders that hold for every request."""

    def __init__(self, ids: np.ndarray):
        self.ids, self._made = ids, {}

    def made(self, key: str, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        if key not in self._made:
            self._made[key] = make(self.ids)
        return self._made[key]


class TokenTrie:
    """Sorted sequences in segments; places are immutable, so many searches share one trie."""

    def __init__(self, segments: Iterable[pa.Table]):
        self.segments = [s.combine_chunks() for s in segments if s.num_rows]
        self.ids, self.starts = [], []
        for s in self.segments:
            column = s["ids"].chunk(0)
            self.ids.append(column.values.to_numpy(zero_copy_only=True))
            self.starts.append(column.offsets.to_numpy(zero_copy_only=True))
        self._known: dict[Place, np.ndarray] = {}
        self._choices: dict[tuple[Place, tuple[int, ...]], Choices] = {}

    @classmethod
    def of(cls, sequences: Iterable[Sequence[int]], names: Iterable[tuple[str, str]] | None = None) -> TokenTrie:
        """A trie of a few sequences that end in END; names are their (entity, code)."""
        rows = sorted(zip(map(tuple, sequences), names, strict=True) if names is not None else ((tuple(s), (None, None)) for s in sequences))
        ids = pa.array([list(s) for s, _ in rows], pa.list_(pa.int32()))
        return cls([pa.table({"ids": ids, "entity": pa.array([n[0] for _, n in rows], pa.string()), "code": pa.array([n[1] for _, n in rows], pa.string())})])

    def extended(self, other: TokenTrie) -> TokenTrie:
        """Both tries' sequences; nothing is copied."""
        return TokenTrie([*self.segments, *other.segments])

    def __len__(self) -> int:
        return sum(s.num_rows for s in self.segments)

    @property
    def nbytes(self) -> int:
        return sum(s.nbytes for s in self.segments)

    def root(self) -> Place:
        return tuple((k, 0, s.num_rows) for k, s in enumerate(self.segments)), 0

    def allowed(self, place: Place) -> np.ndarray:
        """The sorted ids that may follow."""
        if place in self._known:
            return self._known[place]
        ranges, depth = place
        parts = []
        for k, lo, hi in ranges:
            # no row of a range ends before depth: END comes last
            t = self.ids[k][self.starts[k][lo:hi] + depth]
            parts.append(t[:1] if t[0] == t[-1] else t[np.concatenate([[True], t[1:] != t[:-1]])])
        out = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)
        if sum(hi - lo for _, lo, hi in ranges) >= WIDE:
            self._known[place] = out
        return out

    def choices(self, place: Place, ends: tuple[int, ...]) -> Choices:
        """What may follow, with ends in the place of END; kept where allowed() is."""
        if (place, ends) in self._choices:
            return self._choices[place, ends]
        ids = self.allowed(place)
        if len(ids) and ids[0] == END:
            ids = np.concatenate([np.array(ends, ids.dtype), ids[1:]])
        out = Choices(ids)
        if place in self._known:
            self._choices[place, ends] = out
        return out

    def step(self, place: Place, token: int) -> Place | None:
        """The place after a token, None where it may not follow. After END the ranges are those of whole names."""
        ranges, depth = place
        out = []
        for k, lo, hi in ranges:
            ids, starts = self.ids[k], self.starts[k]
            if ids[starts[lo] + depth] > token or ids[starts[hi - 1] + depth] < token:
                continue
            a = self._bound(k, lo, hi, depth, token)
            b = self._bound(k, a, hi, depth, token + 1)
            if a < b:
                out.append((k, a, b))
        return (tuple(out), depth + 1) if out else None

    def _bound(self, k: int, lo: int, hi: int, depth: int, token: int) -> int:
        """The first row of a range whose token at depth is not less."""
        ids, starts = self.ids[k], self.starts[k]
        while lo < hi:
            mid = (lo + hi) // 2
            if ids[starts[mid] + depth] < token:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def find(self, prefix: Iterable[int]) -> Place | None:
        place = self.root()
        for t in prefix:
            if (place := self.step(place, t)) is None:
                return None
        return place

    def get(self, prefix: Iterable[int]) -> list[int]:
        """The ids that may follow a prefix; none where it is no beginning or a whole name."""
        prefix = list(prefix)
        if END in prefix or (place := self.find(prefix)) is None:
            return []
        return self.allowed(place).tolist()

    def name(self, place: Place) -> tuple[str | None, str | None]:
        """(entity, code) of a place after END: the least of them."""
        found = [(self.segments[k]["entity"][i].as_py(), self.segments[k]["code"][i].as_py()) for k, lo, hi in place[0] for i in range(lo, hi)]
        return min(found, key=lambda x: (x[0] or "", x[1] or ""))

    def sequences(self) -> Iterator[list[int]]:
        for s in self.segments:
            for row in s["ids"].to_pylist():
                yield row


class Spliced:
    """A trie whose beginnings with one token are replaced by those of another; prefixes that it lacks are looked up there."""

    def __init__(self, trie: TokenTrie, token: int, other: TokenTrie):
        self.trie, self.token, self.other = trie, token, other

    def get(self, prefix: Iterable[int]) -> list[int]:
        prefix = list(prefix)
        if not prefix:
            own = self.trie.get([])
            return sorted({*(t for t in own if t != self.token), *self.other.get([])}) if self.token in own else own
        return self.trie.get(prefix) or self.other.get(prefix)


MANIFEST = "grp string, file string, part int, rows long, tokens long, bytes long"


def write(names: DataFrame, ids: Callable[[Column], Column] = hashed_words, segment_rows: int = SEGMENT_ROWS) -> str:
    """Writes the tries of names(grp, entity, code), one a group, to the shared folder, and returns the path of their manifest.

    Of names that are one token sequence the least (entity, code) stays; null groups and names are left out. Names are
    sorted by ranges over all tasks, however large a group is, and a task holds one segment at a time. A segment has the
    name of its own attempt; readers follow the manifest, which lists those of finished tasks only.
    """
    from ..sources import storage

    d = names.where("entity is not null AND grp is not null").select("grp", T.clean_natural(F.col("entity")).alias("entity"), "code")
    d = d.select("grp", ids(F.col("entity")).alias("ids"), F.struct("entity", "code").alias("name")).groupBy("grp", "ids").agg(F.min("name").alias("name"))
    d = storage.materialize(d, "sequences")
    d = d.repartitionByRange("grp", "ids").sortWithinPartitions("grp", "ids").select("grp", "ids", "name.*", F.spark_partition_id().alias("part"))
    folder = storage.fresh_path(names.sparkSession, "tries")

    def segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held: list[pa.RecordBatch] = []
        rows: list[tuple] = []

        def flush() -> None:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            file = f"{uuid.uuid4().hex}.arrow"
            body = t.select(["ids", "entity", "code"])
            with fs.open_output_stream(f"{root}/{file}.part") as out, pa.ipc.new_file(out, body.schema) as w:
                w.write_table(body, max_chunksize=max(1, body.num_rows))
            fs.move(f"{root}/{file}.part", f"{root}/{file}")
            rows.append((t["grp"][0].as_py(), file, t["part"][0].as_py(), t.num_rows, len(t["ids"].chunk(0).values), body.nbytes))

        for b in it:
            groups = b.column("grp")
            cuts = [0, *(i for i in range(1, b.num_rows) if groups[i] != groups[i - 1]), b.num_rows] if b.num_rows and groups[0] != groups[b.num_rows - 1] else [0, b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if held and z > a and held[0].column("grp")[0] != groups[a]:
                    flush()
                while a < z:
                    n = min(z - a, segment_rows - sum(x.num_rows for x in held))
                    held.append(b.slice(a, n))
                    a += n
                    if sum(x.num_rows for x in held) >= segment_rows:
                        flush()
        flush()
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["grp", "file", "part", "rows", "tokens", "bytes"])

    manifest = d.mapInArrow(segments, MANIFEST).withColumn("folder", F.lit(folder))
    path = storage.fresh_path(names.sparkSession, "tries-manifest")
    manifest.write.parquet(path)
    return path


class Shelf:
    """The tries of a manifest, loaded a group at a time in the tasks; a worker keeps as many as fit in a bound of bytes."""

    def __init__(self, manifest: str, max_bytes: int = 256 << 20):
        self.manifest, self.max_bytes = manifest, max_bytes
        self._held: OrderedDict[str | None, TokenTrie] = OrderedDict()
        self._listed: dict[str, list[dict]] | None = None

    def __getstate__(self):
        return {"manifest": self.manifest, "max_bytes": self.max_bytes, "_held": OrderedDict(), "_listed": None}

    def __call__(self, group: str | None) -> TokenTrie:
        """The trie of a group, empty for a group without names. The largest bound that holds is one trie."""
        if group in self._held:
            self._held.move_to_end(group)
            return self._held[group]
        trie = TokenTrie(self._segments(group))
        self._held[group] = trie
        while len(self._held) > 1 and sum(t.nbytes for t in self._held.values()) > self.max_bytes:
            self._held.popitem(last=False)
        return trie

    def _segments(self, group: str | None) -> list[pa.Table]:
        if group is None:
            return []
        if self._listed is None:
            # a row a segment, read once a worker and not once a group
            fs, root = pafs.FileSystem.from_uri(self.manifest)
            files = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".parquet")]
            self._listed = {}
            for r in (r for f in files for r in pq.ParquetFile(fs.open_input_file(f)).read().to_pylist()):
                self._listed.setdefault(r["grp"], []).append(r)
        out = []
        for r in sorted(self._listed.get(group, ()), key=lambda r: (r["part"], r["file"])):
            fs, root = pafs.FileSystem.from_uri(r["folder"])
            at = f"{root}/{r['file']}"
            local = isinstance(fs, pafs.LocalFileSystem)
            source = pa.memory_map(at) if local else pa.BufferReader(fs.open_input_file(at).read_buffer())
            out.append(pa.ipc.open_file(source).read_all())
        return out


def edges(manifest: DataFrame, path: str) -> DataFrame:
    """(grp, depth, prefix, next) of every step of the tries at path, one task a segment: the trie read back as a table.

    manifest is spark.read.parquet(path). Steps that two segments of a group share stand there once.
    """

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                fs, root = pafs.FileSystem.from_uri(r["folder"])
                trie = TokenTrie([pa.ipc.open_file(pa.BufferReader(fs.open_input_file(f"{root}/{r['file']}").read_buffer())).read_all()])
                rows, open_ = [], [(trie.root(), [])]
                while open_:
                    place, prefix = open_.pop()
                    for t in trie.allowed(place).tolist():
                        rows.append((prefix, t))
                        if t != END:
                            open_.append((trie.step(place, t), [*prefix, t]))
                    if len(rows) >= 1 << 14 or not open_:
                        yield pa.RecordBatch.from_arrays([pa.array([r["grp"]] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.list_(pa.int32())), pa.array([n for _, n in rows], pa.int32())], names=["grp", "prefix", "next"])
                        rows = []

    d = manifest.repartition(F.col("file")).mapInArrow(walk, "grp string, prefix array<int>, next int").distinct()
    return d.select("grp", F.size("prefix").alias("depth"), "prefix", "next")
