"""Encoding with merge-type piece vocabularies, and decoding.

A text becomes symbols of one character each. An agenda, ordered by score and
then by place, holds every adjacent pair that is a piece; the best pair is merged
and its new neighbours join the agenda, until none is left. Symbols outside the
vocabulary become byte pieces.

No piece of such a vocabulary has a word-start mark behind another character,
so pairs never reach over the start of a word and words can be merged one by one;
a task remembers the words it has seen. Every new word of an Arrow batch is also
given to the sentencepiece library, and a text whose words do not all agree with
it is marked.

Null and empty texts have no pieces and decode to an empty text. Texts of any
length are taken whole; repeated rows are encoded each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.common import list_array, with_columns

MARK = "▁"
#: Words a task remembers; beyond it, it starts anew. It bounds memory and changes no result.
REMEMBERED = 700_000
#: Characters up to which the agenda is a plain list.
SHORT, NEVER = 32, float("inf")


class Merger:
    """The vocabulary of a model and its agenda of pairs."""

    def __init__(self, processor):
        ids = range(processor.get_piece_size())
        plain = [i for i in ids if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
        self.ids = {processor.id_to_piece(i): i for i in plain}
        self.rank = {processor.id_to_piece(i): -processor.get_score(i) for i in plain}
        self.bytes = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = processor.unk_id()
        self.by_bytes = all(processor.is_byte(i) for i in self.bytes)
        self.by_words = not any(MARK in p.lstrip(MARK) for p in self.ids)

    def pieces(self, text: str) -> list[str]:
        """The text's pieces after all merges."""
        if len(text) <= SHORT:
            return self._short(text)
        rank, symbols = self.rank, list(text)
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapify(agenda)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while agenda:
            _, i, j, size = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has been merged meanwhile
            merged = symbols[i] = left + right
            symbols[j] = ""
            k, h = after[j], before[i]
            after[i] = k
            if k >= 0:
                before[k] = i
                r = rank.get(merged + symbols[k])
                if r is not None:
                    heappush(agenda, (r, i, k, size + len(symbols[k])))
            if h >= 0:
                r = rank.get(symbols[h] + merged)
                if r is not None:
                    heappush(agenda, (r, h, i, size + len(symbols[h])))
        return [s for s in symbols if s]

    def _short(self, text: str) -> list[str]:
        """The same with a plain list as agenda: of few pairs the best is found faster by looking at all."""
        get, symbols = self.rank.get, list(text)
        ranks = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            symbols[i] = merged = symbols[i] + symbols.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = get(merged + symbols[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(symbols[i - 1] + merged, NEVER)
        return symbols

    def encode(self, text: str) -> list[int]:
        """Ids of a normalised text (spaces are marks already)."""
        out: list[int] = []
        for piece in self.pieces(text):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.by_bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first mark."""
        text = text.replace(" ", MARK)
        if not self.by_words:
            return [text]
        if MARK + MARK not in MARK + text:
            return text.split(MARK)
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text)]


def load(path: str):
    """The library's processor for the model file, and the bytes of the model.

    Only models that merge pairs, leave characters as they are, and mark the
    start of a text are taken; another one raises ValueError.
    """
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = open(path, "rb").read()
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    rules, fits = spec.normalizer_spec, spec.trainer_spec.model_type == spec.trainer_spec.BPE
    if not fits or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError(f"{path}: not a merge-type model with plain characters and a mark at the start")
    if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in spec.pieces):
        raise ValueError(f"{path}: user-defined or unused pieces are not handled")
    return SentencePieceProcessor(model_proto=model), model


def _maker(model: bytes, decode: bool) -> Callable:
    def make():
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        merger = Merger(library)
        known: dict[str, bytes] = {}
        odd: set[str] = set()

        def learn(new: list[str]) -> None:
            # the library puts a mark before a text itself; a lone mark has no text of its own
            asked = [w for w in new if w]
            theirs = dict(zip(asked, library.encode([w.replace(MARK, " ") for w in asked], num_threads=1)))
            for w in new:
                ids = merger.encode(MARK + w)
                if w and theirs[w] != ids:
                    odd.add(w)
                known[w] = np.array(ids, np.int32).tobytes()

        def work(texts):
            if len(known) > REMEMBERED:
                known.clear()
            split = [merger.words(t) if t else [] for t in texts]
            learn(list(set().union(*split).difference(known)))
            blobs = [b"".join([known[w] for w in words]) for words in split]
            out = [list_array(blobs, np.int32, pa.int32()), [not odd or odd.isdisjoint(words) for words in split]]
            if decode:
                out.append([library.decode(np.frombuffer(b, np.int32).tolist()) if b else "" for b in blobs])
            return out

        return work

    return make


def encode(
    docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, decode: bool = True,
) -> DataFrame:
    """The kept columns, ``ids`` array<int>, ``agrees`` (with the library), and ``decoded``.

    Each text is encoded whole, without begin or end ids, then decoded by the
    library. Columns of ``docs`` with these names give way.
    """
    _, model = load(model_path)
    fields = [("ids", T.ArrayType(T.IntegerType(), False)), ("agrees", T.BooleanType())]
    return with_columns(
        docs, _maker(model, decode), [*fields, *([("decoded", T.StringType())] if decode else [])], text, keep,
    )
