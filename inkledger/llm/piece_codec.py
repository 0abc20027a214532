"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (blank to U+2581, one dummy prefix), cut where no piece of the vocabulary can reach across, and
every segment is merged by an agenda of adjacent symbol pairs: best score first, the leftmost of equals. Equal
segments give equal pieces, so a bounded table per worker keeps their results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
OUTPUT = "n_tokens long, ids_sha256 string, decoded_sha256 string, library_match boolean"


class PieceCodec:
    """One merge-type vocabulary; models with other normalisation, unused or user-defined pieces are refused."""

    def __init__(self, path: str, keep: int = 600_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only merge-type models with identity normalisation are supported")
        if {p.type for p in proto.pieces} - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk, self.eos = self.library.unk_id(), self.library.eos_id()
        self.unk_surface = proto.trainer_spec.unk_surface
        # A new word starts at each mark that follows something else, if no piece holds a mark after another character.
        inner = any(MARK in p.lstrip(MARK) for p in self.score)
        self.cuts = not inner and "\n" not in self.score and not any("\n" in p for p in self.score)
        alone = "" if any("\n" in p and len(p) > 1 for p in self.score) else "\n"
        self.cut = re.compile(r"(?s).+") if inner else re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|{alone or '$^'}")
        self.keep, self.known = keep, {}
        self.fresh: list[tuple[str, list[int], str]] = []

    def merge(self, segment: str) -> list[str]:
        """The agenda over one segment: a flat list of pair scores for words, a heap for what is longer."""
        if len(segment) > 48:
            return self._merge_long(segment)
        symbols, score, none = list(segment), self.score.get, float("-inf")
        agenda = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) != none:
            i = agenda.index(best)  # the leftmost of equals
            symbols[i : i + 2] = [merged := symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + merged, none)
            if i < len(agenda):
                agenda[i] = score(merged + symbols[i + 1], none)
        return symbols

    def _merge_long(self, segment: str) -> list[str]:
        symbols = list(segment)
        n, score, agenda = len(symbols), self.score, []
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        push, pop = heapq.heappush, heapq.heappop
        for i in range(n - 1):
            if (s := score.get(symbols[i] + symbols[i + 1])) is not None:
                agenda.append((-s, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = pop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one side has been merged into something else meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
                if (s := score.get(symbols[left] + symbols[nxt])) is not None:
                    push(agenda, (-s, left, nxt, len(symbols[left]) + len(symbols[nxt])))
            if (prv := before[left]) >= 0 and (s := score.get(symbols[prv] + symbols[left])) is not None:
                push(agenda, (-s, prv, left, len(symbols[prv]) + len(symbols[left])))
        return [s for s in symbols if s]

    def segment_ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(segment):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unk)
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def lookup(self, segment: str) -> tuple[str, str]:
        """The decimal ids, joined by blanks, and the decoded surface of a segment."""
        if (got := self.known.get(segment)) is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            ids = self.segment_ids(segment)
            got = " ".join(map(str, ids)), self.surface(ids)
            self.fresh.append((segment, ids, got[1]))
            if len(segment) < 64:
                self.known[segment] = got
        return got

    def disagreeing(self) -> set[str]:
        """Segments merged since the last call that the library encodes or decodes otherwise.

        The library sees each after a line end, which no piece reaches across, so its first ids are always the same.
        """
        fresh, self.fresh = self.fresh, []
        lead = self.library.encode("\n")
        theirs = self.library.encode(["\n" + s.replace(MARK, " ") for s, _, _ in fresh], num_threads=1)
        texts = self.library.decode(theirs, num_threads=1) if fresh else []
        return {s for (s, ids, text), ids2, text2 in zip(fresh, theirs, texts, strict=True) if ids2 != lead + ids or text2 != "\n" + text}

    def encode(self, text: str | None, eos: bool = True) -> list[int]:
        """Ids of a text; a null or empty text has the end id alone."""
        ids = [i for s in self.segments(text or "") for i in self.segment_ids(s)]
        return ids + [self.eos] * eos

    def surface(self, ids: Iterable[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8, marks still leading."""
        out, run = [], bytearray()
        for i in ids:
            if self.kinds[i] == 6:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.kinds[i] == 1:
                out.append(self.pieces[i].replace(MARK, " "))
            elif self.kinds[i] == 2:
                out.append(self.unk_surface)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        text = self.surface(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One per worker process and model."""
    return PieceCodec(path)


def piece_digests(docs: DataFrame, path: str | Callable[[], str], key: str = "doc_id", text: str = "text", verify: str = "segments") -> DataFrame:
    """Encode with an end id and decode each whole text; digests of both, and whether the library agrees.

    A null text counts as empty (one id, empty decoded text). Repeated rows give repeated rows; other columns are not
    read. With each Arrow batch the library encodes and decodes the same input: every segment that the batch merged anew
    (``verify="segments"``) or every whole text (``"texts"``, slower); ``library_match`` tells if it agrees, and is null
    with ``"none"``. ``path`` may be a function that each worker calls for its own path. Memory: one slice of a batch and
    a table of at most 600,000 segments.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path if isinstance(path, str) else path())
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        known, look, eos = c.known, c.lookup, str(c.eos)
        wrong: set[str] = set()
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, ids, back, match = [], [], [], []
            for t in texts:
                segments = c.segments(t)
                got = [known.get(s) or look(s) for s in segments]
                line = " ".join([g[0] for g in got] + [eos])
                text_back = "".join([g[1] for g in got])
                if c.prefix and text_back.startswith(" "):
                    text_back = text_back[1:]
                n.append(line.count(" ") + 1)
                ids.append(sha(line))
                back.append(sha(text_back))
                if verify == "texts" or verify == "segments" and not c.cuts:
                    theirs = c.library.encode(t, add_eos=True)
                    match.append(" ".join(map(str, theirs)) == line and c.library.decode(theirs) == text_back)
            if verify == "segments" and c.cuts:
                wrong |= c.disagreeing()
                match = [not wrong or wrong.isdisjoint(c.segments(t)) for t in texts]
            elif verify == "none":
                match = [None] * len(texts)
            c.fresh.clear()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array(match, pa.bool_())], [key, "n_tokens", "ids_sha256", "decoded_sha256", "library_match"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, {OUTPUT}")
