"""Token ids and their binary files: encode documents, write equal-length sequences, read them back.

A *shard* is an Arrow stream in a file. Every record batch holds ``rows_per_batch`` rows (the last may hold fewer) of two
fixed-size lists of ``seq_len``: ``tokens`` (uint16 where the vocabulary allows it, else uint32) and ``mask`` (true where
a token is no padding). Nothing is compressed, so a memory map gives sequences without a copy; the offset of each batch
is kept beside the shard, with the place of each document, in an Arrow file ``<shard>.docs``.

Documents are laid end to end in ascending id order (null ids first, repeated ids by text); sequences cut across
documents. Each shard pads its last sequence, so shards are independent of each other and a lost task rewrites its own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm._io import Scratch, slices

#: Bytes of a generation of remembered pieces, and what an entry takes besides its text and ids.
REMEMBERED, ENTRY = 40 << 20, 160
#: Pieces that go to the library as one text.
TOGETHER = 48
_BLANK = frozenset(" \t\n\r\x0b\x0c")
#: White space inside ASCII; every tokenizer rule here treats it as space.
_LEAD = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Characters that some libraries count as white space and some do not; texts that hold one are encoded in one piece.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

#: A word of Latin-1 letters, which the pattern of the rule ``word`` never splits, and marks behind it, which are another unit.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)\"*$&%#]*)")


def _letters() -> dict[int, str]:
    """The letter that byte-level tokens have for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([*own, *(b for b in range(256) if b not in set(own))], map(chr, [*own, *range(256, 512)]), strict=False))


def _cut_rule(config: dict) -> str | None:
    """How a text may be cut so that the ids of the pieces, joined, are the ids of the text.

    ``lead``: byte-level BPE with its standard pattern never lets a token run from a visible character into white space.
    ``word``: a split that removes white space never lets a token touch it (letters are lower-cased first).
    """
    pre = config.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not config.get("normalizer"):
        return "lead"
    parts = pre.get("pretokenizers") or []
    normal = {x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])}
    if parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and "Lowercase" in normal and normal <= {"NFC", "Replace", "Lowercase"}:
        return "word"
    return None


class PieceEncoder:
    """Ids of whole texts, as the library's ``encode(text, add_special_tokens=False)`` gives them, with a bounded memory of
    pieces met before.

    The library encodes every distinct piece; a text's ids are those of its pieces, joined. Where no cut is known to be
    safe, and for texts with unusual white space or an added token such as an end mark, the whole text is encoded at once.
    The memory has two generations of at most ``remembered`` bytes: a full young one becomes the old one, and what is met
    again comes back from it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.rule = _cut_rule(config)
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in config.get("added_tokens") or []) or "(?!)", re.I)
        suffix = config["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab()
        #: Bytes of text that each id stands for: byte-level tokens have a letter for each.
        self.spans = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.spans[i] = len(token) - len(suffix) * bool(suffix and token.endswith(suffix))
        self.letters, self.marked = _letters(), {"": b""}
        self.remembered, self.used = remembered, 0
        self.known: dict = {}
        self.old: dict = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, text: str) -> bytes:
        """Ids of what the pattern never splits, straight from the library's model."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _ids_of(self, pieces: list) -> list[bytes]:
        """Ids of distinct pieces. With the rule ``word``, whose normalizers take most of the time, plain words and the marks behind
        them are units; all else goes through the whole library."""
        if self.rule != "word":
            return self._joined_ids(pieces)
        out, met, marked = [], {}, self.marked
        for p in pieces:
            found = _WORD.fullmatch(p.decode())
            if not found:
                out.append(None)
                continue
            unit, marks = found.groups()
            ids = met.get(unit)
            if ids is None:
                ids = met[unit] = self.known.get(unit.encode()) or self._unit(unit)
            if marks not in marked:
                if len(marked) > 4096:
                    marked.clear()
                    marked[""] = b""
                marked[marks] = self._unit(marks)
            out.append(ids + marked[marks])
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._joined_ids([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _joined_ids(self, pieces: list) -> list[bytes]:
        """Ids of distinct pieces. Most go to the library some dozens at a time, as a text that cuts into them again; the
        bytes that each id stands for say where the ids of a piece end. Where they don't say so, a piece goes alone."""
        out: list[bytes | None] = [None] * len(pieces)
        if self.rule == "lead":
            fit = [i for i, p in enumerate(pieces) if p[0] in _BLANK and p[-1] not in _BLANK]
            own = [pieces[i] for i in fit]
            sizes = [len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in own]
            joint = ""
        else:
            pieces = [p.decode() for p in pieces]
            fit, own, joint = range(len(pieces)), pieces, " "
            normal = self.tokenizer.normalizer.normalize_str(joint.join(own)).split(joint) if own else []
            sizes = [len(p.encode()) for p in normal] if len(normal) == len(own) else []
        if len(sizes) == len(own):
            texts = [joint.join(own[a : a + TOGETHER]) for a in range(0, len(own), TOGETHER)]
            for k, found in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.asarray(found.ids, dtype="<u4")
                ends = np.cumsum(sizes[k * TOGETHER : (k + 1) * TOGETHER])
                have = np.cumsum(self.spans[ids])
                stops = np.searchsorted(have, ends)
                if len(have) and have[-1] == ends[-1] and (have[np.minimum(stops, len(have) - 1)] == ends).all():
                    raw, begin = ids.tobytes(), 0
                    for i, end in zip(fit[k * TOGETHER : (k + 1) * TOGETHER], (4 * (stops + 1)).tolist(), strict=True):
                        out[i] = raw[begin:end]
                        begin = end
        alone = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(alone, self._library([pieces[i] for i in alone]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        out: list[bytes] = []
        texts = [t or "" for t in texts]
        for a, b in slices(texts, 1 << 18):
            out += self._encode(texts[a:b])
        return out

    def _cut(self, text: str) -> list | None:
        if self.marks.search(text):
            return None
        if self.rule == "lead":
            return None if _ODD.search(text) else _LEAD.findall(text)
        return text.encode().lower().split()  # the tokenizer lower-cases all letters, here only A-Z

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.rule is None:
            return self._library(texts)
        if self.used > self.remembered:
            self.known, self.old, self.used = {}, self.known, 0
        pieces = [self._cut(t) for t in texts]
        known, old = self.known, self.old
        new = set().union(*filter(None, pieces)).difference(known)
        if new:
            again = [p for p in new if p in old] if old else []  # set methods would walk all of ``old``
            new.difference_update(again)
            fresh = list(new)
            for keys, ids in ((again, list(map(old.__getitem__, again))), (fresh, self._ids_of(fresh))):
                known.update(zip(keys, ids, strict=True))
                self.used += sum(map(len, keys)) + sum(map(len, ids)) + ENTRY * len(keys)
        get = known.__getitem__
        return [self._library([t])[0] if own is None else b"".join(map(get, own)) for t, own in zip(texts, pieces, strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str, remembered: int = REMEMBERED) -> PieceEncoder:
    """One encoder for each vocabulary and Python worker."""
    return PieceEncoder(path, remembered)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends documents' ids to one shard."""

    def __init__(self, uri: str, seq_len: int, rows_per_batch: int, wide: bool):
        self.fs, path = _file_system(uri)
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        self.path, self.part = path, f"{path}.{os.getpid()}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.seq_len, self.rows = seq_len, rows_per_batch
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.schema = shard_schema(seq_len, wide)
        self.sink = self.fs.open_output_stream(self.part)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: list[tuple] = []
        self.batches: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= self.seq_len * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        full = self.seq_len * self.rows
        at = 0
        while len(flat) - at >= full or last and at < len(flat):
            own = flat[at : at + full]
            at += len(own)
            pad = -len(own) % self.seq_len
            mask = np.ones(len(own) + pad, dtype=bool)
            mask[len(own) :] = False
            tokens = np.concatenate([own, np.zeros(pad, self.kind)]) if pad else own
            self.batches.append(self.sink.tell() or self.schema.serialize().size)  # the schema goes out with the first batch
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (tokens, mask)]
            self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.waiting = [flat[at:]]
        self.held = len(flat) - at

    def close(self) -> dict:
        self._flush(True)
        self.stream.close()
        self.sink.close()
        ids, starts, sizes = ([d[i] for d in self.docs] for i in range(3))
        meta = {"batches": json.dumps(self.batches), "rows_per_batch": str(self.rows), "total": str(self.total)}
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())}).replace_schema_metadata(meta)
        with self.fs.open_output_stream(f"{self.part}.docs") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        self.fs.move(self.part, self.path)  # one step: a task that runs again replaces the same file
        self.fs.move(f"{self.part}.docs", f"{self.path}.docs")
        return {"n_docs": len(self.docs), "n_tokens": self.total}


def shard_schema(seq_len: int, wide: bool) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class ShardReader:
    """Random access to one shard; on a local or mounted file system nothing is copied."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, path = _file_system(uri)
        self.source = pa.memory_map(path) if isinstance(self.fs, fs.LocalFileSystem) else self.fs.open_input_file(path)
        with self.fs.open_input_file(f"{path}.docs") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        meta = {k.decode(): v.decode() for k, v in self.docs.schema.metadata.items()}
        self.batches, self.rows, self.total = json.loads(meta["batches"]), int(meta["rows_per_batch"]), int(meta["total"])
        self.schema = pa.ipc.open_stream(self.source).schema
        self.seq_len = self.schema.field("tokens").type.list_size

    def __len__(self) -> int:
        return -(-self.total // self.seq_len)

    def batch(self, k: int) -> pa.RecordBatch:
        self.source.seek(self.batches[k])
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Tokens and mask of the i-th sequence."""
        own = self.batch(i // self.rows)
        k = i % self.rows * self.seq_len
        tokens, mask = own.column(0).values, own.column(1).values
        return tokens.slice(k, self.seq_len).to_numpy(zero_copy_only=True), mask.slice(k, self.seq_len)

    def spans(self):
        """(first place, ids) of each batch in turn, without padding."""
        for k in range(len(self.batches)):
            at = k * self.rows * self.seq_len
            yield at, self.batch(k).column(0).values.to_numpy(zero_copy_only=True)[: self.total - at]

    def close(self) -> None:
        self.source.close()


def write_shards(
    docs: DataFrame, out: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, seq_len: int = 2048, rows_per_batch: int = 64, remembered: int = REMEMBERED
) -> DataFrame:
    """Encodes whole texts and writes them as shards below ``out``, in ascending id order.

    One range shuffle of the texts; encoding and writing happen in the same task, so ids are never shuffled. Returns,
    lazily, a row per shard: shard, path, n_docs, n_tokens. Writing the result twice rewrites the same files.
    Null texts count as empty and get ``end_id`` alone; an empty table gives no shard; other columns are not read.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches):
        enc = encoder(vocabulary, remembered)
        wide = enc.tokenizer.get_vocab_size() > 1 << 16
        k = TaskContext.get().partitionId()
        path, writer = f"{out}/shard-{k:08d}.arrows", None
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):  # the texts of a batch never stand in Python together
                for doc_id, own in zip(ids[at : at + 256], enc.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    writer = writer or ShardWriter(path, seq_len, rows_per_batch, wide)
                    writer.add(doc_id, np.frombuffer(own + end, dtype="<u4"))
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "path": [path], "n_docs": pa.array([done["n_docs"]], pa.int64()), "n_tokens": pa.array([done["n_tokens"]], pa.int64())})

    return ordered.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame, shards: int) -> DataFrame:
    """Per document of the shards in ``manifest``: doc_id, start (ids before it), n_tokens, ids_crc32, shard.

    The running total needs one row per shard in one task; documents are read where their shard is dealt to.
    """
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    dealt = based.select("shard", "path", F.coalesce("base", F.lit(0)).cast("long").alias("base")).repartition(max(1, shards), "shard")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(row["path"])
                starts = reader.docs.column("start").to_numpy()
                sizes = reader.docs.column("n_tokens").to_numpy()
                crcs = np.zeros(len(starts), dtype=np.int64)
                k = 0
                for at, ids in reader.spans():
                    ids = ids.astype("<u4")
                    while k < len(starts) and starts[k] < at + len(ids):
                        a, b = max(starts[k], at), min(starts[k] + sizes[k], at + len(ids))
                        crcs[k] = zlib.crc32(ids[a - at : b - at], crcs[k])
                        if starts[k] + sizes[k] > at + len(ids):
                            break  # goes on in the next batch
                        k += 1
                yield pa.RecordBatch.from_arrays([reader.docs.column("doc_id").combine_chunks(), pa.array(starts + row["base"]), pa.array(sizes), pa.array(crcs), pa.array(np.full(len(starts), row["shard"], dtype=np.int32))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
                reader.close()

    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_files(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes the shards in the shared folder, reads them back, and returns what ``read_shards`` returns.

    The files go once the rows are read; to keep files, call ``write_shards`` with a folder of your own.
    """
    with Scratch(docs.sparkSession, "tokens") as scratch:
        manifest = scratch.table(write_shards(docs, scratch.path("shards"), vocabulary, **options), "manifest")
        return scratch.keep(read_shards(manifest, manifest.count()))
