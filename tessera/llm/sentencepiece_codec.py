"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed on the driver and rebuilt: its normaliser (character
map, extra white space, dummy prefix), the metaspace marker for spaces, its scores
(unigram, or for BPE the order of merges that they imply) and byte fallback. The
rebuilt tokenizer goes to the executors as one JSON string, whose size is that of the
vocabulary. Texts are encoded and decoded in batches of bounded bytes on ``threads``
threads of a task.

For BPE a merge joins any two pieces whose join is a piece; merges go by the joined
piece's score. Among equal scores SentencePiece takes the leftmost pair, which for the
runs of spaces that share one score is the longest left part first, so ties are ordered
so. ``parity`` compares the rebuilt tokenizer with the original library.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textlib import parts

MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Codec:
    """A rebuilt tokenizer as JSON, bytes of text in a batch, threads of a task."""

    json: str
    batch_bytes: int = 1 << 18
    threads: int = 2

    def tokenizer(self):
        os.environ["RAYON_NUM_THREADS"] = str(self.threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from tokenizers import Tokenizer

        if (cached := _LOADED.get(self.json)) is None:
            _LOADED.clear()
            cached = _LOADED[self.json] = Tokenizer.from_str(self.json)
        return cached


_LOADED: dict = {}


def rebuild(model: bytes, **kw) -> Codec:
    """The tokenizer of a serialised unigram or BPE model."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = pb.ModelProto.FromString(model)
    kind, rule = proto.trainer_spec.model_type, proto.normalizer_spec
    pieces = [(p.piece, p.score) for p in proto.pieces]
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    fallback = any(p.type == BYTE for p in proto.pieces)
    if kind == 1:
        core = models.Unigram(pieces, unknown, fallback)
    elif kind == 2:
        vocab = {p: i for i, (p, _) in enumerate(pieces)}
        usable = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, USER)}
        merges = [(-score, -i, p[:i], p[i:]) for p, score in usable.items() for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        core = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"neither unigram nor BPE: model type {kind}")
    steps = [normalizers.Precompiled(rule.precompiled_charsmap)] if rule.precompiled_charsmap else []
    if rule.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if rule.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    # No piece joins a letter to a marker after it: words can be split before the marker, which lets them be cached.
    if not any(MARK in p.lstrip(MARK) for p, _ in pieces):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    ends = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*ends, decoders.Strip(" ", 1, 0)] if rule.add_dummy_prefix else ends)
    return Codec(out.to_str(), **kw)


def load(path: str = MODEL_FILE, **kw) -> Codec:
    with open(path, "rb") as f:
        return rebuild(f.read(), **kw)


def parity(model: bytes, texts: Sequence[str]) -> list[str]:
    """The texts for which the rebuilt tokenizer and the original library differ in ids."""
    import sentencepiece

    mine, theirs = rebuild(model).tokenizer(), sentencepiece.SentencePieceProcessor(model_proto=model)
    got = mine.encode_batch_fast(list(texts), add_special_tokens=False)
    return [t for t, a, b in zip(texts, got, theirs.encode(list(texts), num_threads=1)) if a.ids != b]


def _groups(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def _encode(codec: Codec, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec.tokenizer()
        for b in parts(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            for i, j in _groups([len(x) for x in texts], codec.batch_bytes):
                part = texts[i:j]
                ids = [e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)]
                arrays = [np.array(x, np.int32) for x in ids]
                n = pa.array([len(x) for x in ids], pa.int64())
                if digest:
                    same = [a == t for a, t in zip(tok.decode_batch(ids, skip_special_tokens=False), part)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), n, pa.array([hashlib.sha256(a.tobytes()).hexdigest() for a in arrays]), pa.array(same)], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])
                else:
                    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in (0, *range(2, b.num_columns))), n, lists], [*(b.schema.names[k] for k in (0, *range(2, b.num_columns))), "n_tokens", "ids"])

    return run


def _decode(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec.tokenizer()
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            for i, j in _groups([4 * len(x) for x in ids], codec.batch_bytes):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(tok.decode_batch(ids[i:j], skip_special_tokens=False), pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, codec: Codec, keep: Sequence[str] = ()) -> DataFrame:
    """Token ids of each row of ``docs`` (doc_id, text): doc_id, the columns in ``keep``, n_tokens, ids.

    Null and empty texts have no tokens. Rows repeated or without doc_id are encoded like
    any other. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep)
    kind = dict(rows.dtypes)
    return rows.mapInArrow(_encode(codec, False), ", ".join(f"`{c}` {kind[c]}" for c in ("doc_id", *keep)) + ", n_tokens long, ids array<int>")


def decode(tokens: DataFrame, codec: Codec) -> DataFrame:
    """Text of each row of ``tokens`` (doc_id, ids); null ids give empty text."""
    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(_decode(codec), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def digest(docs: DataFrame, codec: Codec) -> DataFrame:
    """Encodes and decodes each row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit), round_trip (decoding gives the text back; null counts as empty)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(codec, True), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, round_trip boolean")
