"""Byte-level BPE encoding and decoding by a sentencepiece model made from the rank table.

No tokenizer is trained: a BPE ModelProto is serialised straight from the vocabulary. Each rank's
bytes become a piece of printable characters (one for each byte), scored by its negative rank, so
that sentencepiece's best-score merges are the lowest-rank merges; normalisation is the identity.
Texts are cut by the vocabulary's pattern and each pre-token is encoded alone. A pre-token that
is itself a piece takes that id without merging, as tiktoken does.

Defined cases: a null text is empty (no ids, the hash of no bytes); special tokens are ordinary
text; repeated rows give repeated rows; only ``doc_id`` and ``text`` are read; an empty table gives
an empty table. Memory: the pre-token cache holds ``CACHE`` entries at most; a very long text is
held once with its ids.
"""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shoebox.llm.common import documents, map_texts, sha256

CACHE = 300_000


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def load_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(read_file(path))


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def byte_chars() -> list[str]:
    """A printable character for each byte; none is white space or sentencepiece's own mark."""
    return [chr(0x100 + b) for b in range(256)]


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece BPE model; piece ids are ranks in order, the unknown last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_chars()
    proto = pb.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        proto.pieces.add(piece="".join(map(chars.__getitem__, token)), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    proto.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = proto.trainer_spec, proto.normalizer_spec
    t.model_type, t.vocab_size, t.byte_fallback = pb.TrainerSpec.BPE, len(proto.pieces), False
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(ranks), -1, -1, -1
    n.name, n.precompiled_charsmap = "identity", b""
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    return proto.SerializeToString()


class ByteBpe:
    """Encodes and decodes with one vocabulary; ``pieces`` caches (ids, decimal ids, decoded)."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = parse_ranks(vocabulary)
        order = sorted(self.ranks.values())
        self.rank_of = None if order == list(range(len(order))) else order
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.table = dict(enumerate(byte_chars()))
        self.pieces: dict[str, tuple[int, str, bytes]] = {}

    def _learn(self, new: list[str]) -> None:
        hard = []
        for x in new:
            rank = self.ranks.get(x.encode())
            if rank is None:
                hard.append(x)
            else:
                self._put(x, [rank])
        mapped = [x.encode().decode("latin-1").translate(self.table) for x in hard]
        for x, ids in zip(hard, self.model.encode(mapped, num_threads=1)):
            self._put(x, ids if self.rank_of is None else [self.rank_of[i] for i in ids])

    def _put(self, x: str, ids: list[int]) -> None:
        self.pieces[x] = (len(ids), ",".join(map(str, ids)), self.decode(ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def cut(self, text: str) -> list[tuple[int, str, bytes]]:
        """(number of ids, decimal ids, decoded bytes) of each pre-token."""
        found = self.find(text)
        known = self.pieces
        new = [x for x in dict.fromkeys(found) if x not in known]
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(dict.fromkeys(found))
            self._learn(new)
        out = list(map(known.__getitem__, found))
        if len(known) > CACHE:
            known.clear()
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.cut(text) for i in ids.split(",")]


@functools.lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(vocabulary, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, ids_sha256, decoded_sha256); ids null unless asked for. The driver reads the
    vocabulary at ``path`` and sends it to the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(read_file(path))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"

    def make():
        bpe = codec(shared.value, pattern)

        def apply(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            n, ids, hashes, decoded = [], [], [], []
            for text in texts:
                cut = bpe.cut(text)
                n.append(sum(x[0] for x in cut))
                joined = ",".join([x[1] for x in cut])
                ids.append(list(map(int, joined.split(","))) if with_ids and joined else [] if with_ids else None)
                hashes.append(sha256(joined.encode()))
                decoded.append(sha256(b"".join([x[2] for x in cut])))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(hashes), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

        return apply

    return map_texts(docs.select("doc_id", "text"), make, schema)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(documents(spark, sf_dir), *default_vocabulary(), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
