"""What the operators of this subpackage share: durable tables and the cached tokenizer."""

from __future__ import annotations

import re
import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where durable tables go if ``spark.checkpoint.dir`` is unset, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints/voxelmill"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares. Only a session of one process may leave
    ``spark.checkpoint.dir`` unset: elsewhere each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(conf).delete(path, True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` that no two rows share: the file of a row (a hash of
    its path) and its place there, so a row has the same one however often it is read and whatever
    executors are lost in between. What isn't read straight from files is settled first."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or not docs.inputFiles():
        docs = settle(docs, "rows")
    place = docs.metadataColumn("_metadata")
    return docs.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(name))


#: Up to so many rows of ids and spans travel to all tasks (50 to 100 MB).
SMALL_ROWS = 500_000


def small_side(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A settled ``table`` for the small side of a join: broadcast if it is counted to have at most
    ``rows`` rows; a longer one is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


#: Keys that more rows share than this, and than one row in HOT_SHARE, are joined apart from others.
HOT_ROWS, HOT_SHARE = 2000, 1000


def join_counted(rows: DataFrame, key: str, table: DataFrame, named: str, count: str, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` and ``table`` on ``key = named``. ``table`` (settled: it is read three
    times) has every key once, with the number of its rows in ``count``; they sum up to ``total``, or less.

    Keys of very many rows, of which there can be no more than ``HOT_SHARE``, are broadcast; the
    rest is shuffled, and no key of it has more than one in ``HOT_SHARE`` of the rows, or
    ``hot_rows``. So no task gets all the rows of a frequent key."""
    if total is None:
        total = table.agg(F.sum(count)).first()[0] or 0
    limit = max(hot_rows, total // HOT_SHARE)
    hot, same = table.filter(F.col(count) > limit), F.col(key) == F.col(named)
    cold = rows.join(F.broadcast(hot.select(named)), same, "left_anti").join(table.filter(F.col(count) <= limit), same)
    return rows.join(F.broadcast(hot), same).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column in ``taken`` has (upper and lower case are the same)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    name = "_voxelmill_process_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].items_ = {}
    return sys.modules[name].items_


class WholeIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        import numpy as np

        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class WordIds(dict):
    """The same ids for files that ``splits_at_blanks`` admits, by way of remembered chunks of text
    between blanks.

    Such a tokenizer drops white space and never joins text across it, so the ids of a text are
    those of its chunks in a row. A chunk of plain characters is split by the tokenizer's own
    pattern and its pieces go to the tokenizer's model; any other goes through the whole
    tokenizer. At most ``limit`` chunks and ``limit`` pieces are remembered, none over ``longest``
    characters, so memory is bounded in bytes too.
    """

    #: Fixed values of such files: the normalizers, the pre-tokenizer's pattern, the end of a word,
    #: and the byte alphabet of byte-level models (printable bytes stand for themselves, the rest
    #: from 256 up).
    NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORD_END = "</w>"
    PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))

    def __init__(self, path: str, limit: int = 300_000, longest: int = 64):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.limit, self.longest = limit, longest
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(self.PIECES).findall
        self.plain = regex.compile(r"[!-~¡-ɏ]+").fullmatch
        printable = set(self.PRINTABLE)
        others = (b for b in range(256) if b not in printable)
        self.bytes_to_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self[""] = b""

    @classmethod
    def splits_at_blanks(cls, path: str) -> bool:
        """Whether the file declares just the steps that this class relies on."""
        import json

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        normal, cut, model = (said.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
        steps = cut.get("pretokenizers") or [{}, {}]
        pieces = {"type": "Split", "pattern": {"Regex": cls.PIECES}, "behavior": "Removed", "invert": True}
        byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and steps[1].get("use_regex") is False
        plain_model = model.get("type") == "BPE" and model.get("end_of_word_suffix") == cls.WORD_END and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        marks = all(t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in said.get("added_tokens") or [])
        return tuple(normal.get("normalizers") or ()) == cls.NORMALIZERS and steps[0] == pieces and byte_level and plain_model and marks and not (said.get("truncation") or said.get("padding") or said.get("post_processor"))

    def of_ids(self, ids) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin1").translate(self.bytes_to_chars)
        ids = self.of_ids(token.id for token in self.model.tokenize(spelled))
        if len(self.pieces) < self.limit and len(piece) <= self.longest:
            self.pieces[piece] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if self.plain(chunk) and "<|" not in chunk:
            known = self.pieces.get
            ids = b"".join([known(p) or self.piece(p) for p in self.split(chunk.lower())])
        else:
            ids = self.of_ids(self.whole.encode(chunk, add_special_tokens=False).ids)
        if len(self) < self.limit and len(chunk) <= self.longest:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def word_ids(path: str) -> WordIds | WholeIds:
    """The tokenizer of a file, one in each process; any file of the tokenizers library will do."""
    cache = process_cache()
    if path not in cache:
        cache[path] = WordIds(path) if WordIds.splits_at_blanks(path) else WholeIds(path)
    return cache[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Taken:
    """Places of a text that spans cover; asks in logarithmic time."""

    def __init__(self, spans):
        from itertools import accumulate

        ordered = sorted(spans)
        self.starts = [s for s, _ in ordered]
        self.ends = list(accumulate((e for _, e in ordered), max))

    def touches(self, start: int, end: int) -> bool:
        from bisect import bisect_left

        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start
