"""SentencePiece encoding and decoding: one Aho-Corasick pass drives the Viterbi search.

The automaton holds every piece of a vocabulary. Reading a text character by character, its state
is the longest piece prefix that ends here; the output links from that state list all pieces that
end here, longest first, and each relaxes the best score of this position from the one where it
starts. One pass gives the segmentation of highest total score; tracing back gives the ids. A
character that no piece covers becomes its UTF-8 bytes (byte pieces) or the unknown id.

Texts are cut where no piece can reach across: before a run of the space mark that follows another
character, and around characters that occur in no piece. The best path of a text is the chain of
its units' best paths, so units are solved once and remembered, in a store of bounded size.

The vocabulary file is read on the driver; tasks get its pieces and scores (a bounded table) and
need no file. Files whose normaliser changes more than spaces are refused.

Defined cases: null and empty texts have no ids; the space mark itself decodes to a space, as the
format has it; ties go to the longer last piece; a text of any length is encoded whole; repeated
rows are encoded alike; an empty table gives an empty result; ``piece_ids`` and ``round_trip``
replace input columns of these names.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spacelens.llm.words import giving_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Units remembered by a task, about 300 bytes each, and steps by failure links.
REMEMBERED = 100_000
FOLLOWED = 200_000
#: A batch of results ends with the row that reaches as many ids or characters.
BATCH_IDS = 500_000
BATCH_CHARS = 2_000_000
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """pieces and scores by id; ``kinds``: n(ormal), b(yte), u(nknown) or c(ontrol)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    prefix: bool = True

    def __post_init__(self):
        if len(self.kinds) != len(self.pieces):
            raise ValueError("one kind for each piece is needed")


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("the model's normaliser rewrites texts; they could not be decoded again")
    kinds = {1: "n", 2: "u", 3: "c", 4: "n", 5: "c", 6: "b"}
    return Vocabulary(
        tuple(p.piece for p in model.pieces),
        tuple(p.score for p in model.pieces),
        "".join(kinds[p.type] for p in model.pieces),
        spec.add_dummy_prefix,
    )


class Automaton:
    """Aho-Corasick over the normal pieces.

    ``step[s]`` maps a character to the next state, ``fail[s]`` is the longest proper suffix
    state, ``ends[s]`` the piece that ends in s as (length, score, id), ``link[s]`` the nearest
    suffix state in which a piece ends (0: none).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float, int] | None] = [None]
        for i, (piece, score, kind) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds)):
            if kind != "n" or not piece:
                continue
            state = 0
            for c in piece:
                after = self.step[state].get(c)
                if after is None:
                    after = len(self.step)
                    self.step[state][c] = after
                    self.step.append({})
                    self.ends.append(None)
                state = after
            if self.ends[state] is None or score > self.ends[state][1]:
                self.ends[state] = (len(piece), score, i)
        self.fail = [0] * len(self.step)
        self.link = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            for c, after in self.step[state].items():
                queue.append(after)
                back = self.fail[state]
                while back and c not in self.step[back]:
                    back = self.fail[back]
                self.fail[after] = back = self.step[back].get(c, 0)
                self.link[after] = back if self.ends[back] else self.link[back]
        self.outputs: list[tuple | None] = [None] * len(self.step)
        self.followed = 0

    def follow(self, state: int, c: str) -> int:
        """The state after ``c`` by way of failure links; some are kept as steps for the next time."""
        back = state
        while back and c not in self.step[back]:
            back = self.fail[back]
        after = self.step[back].get(c, 0)
        if self.followed < FOLLOWED:
            self.step[state][c] = after
            self.followed += 1
        return after

    def outputs_of(self, state: int) -> tuple:
        """The pieces that end in a state, longest first, by its output links; kept likewise."""
        found, at = [], state if self.ends[state] else self.link[state]
        while at:
            found.append(self.ends[at])
            at = self.link[at]
        self.outputs[state] = tuple(found)
        return self.outputs[state]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.automaton = Automaton(v)
        normal = [(p, s) for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == "n" and p]
        self.unknown_score = min((s for _, s in normal), default=0.0) - UNKNOWN_PENALTY
        self.unknown = v.kinds.find("u")
        self.singles = {p for p, _ in normal if len(p) == 1}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == "b"}
        self.bytes_known = len(self.byte_ids) == 256
        known = sorted({c for p, _ in normal for c in p} - {MARK})
        self.safe = safe = not any(MARK in p.lstrip(MARK) for p, _ in normal)
        inside = "[" + "".join(map(re.escape, known)) + "]" if known else "(?!)"
        # Without a safe cut before space marks, only unknown characters part units.
        pattern = f"{MARK}*{inside}+|{MARK}+|." if safe else f"(?:{MARK}|{inside})+|."
        self.units = re.compile(pattern, re.S)
        self.remembered: dict[str, array] = {}
        self.table = [self._bytes(p, k) for p, k in zip(v.pieces, v.kinds)]

    @staticmethod
    def _bytes(piece: str, kind: str) -> bytes:
        if kind == "b":
            return bytes([int(piece[3:5], 16)])
        if kind == "c":
            return b""
        if kind == "u":
            return " ⁇ ".encode()
        return piece.replace(MARK, " ").encode()

    def solve(self, unit: str) -> array:
        """The ids of the best path through one unit."""
        step, outputs = self.automaton.step, self.automaton.outputs
        singles, unknown_score = self.singles, self.unknown_score
        low = float("-inf")
        n = len(unit)
        best, come, by = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        state = 0
        for i, c in enumerate(unit, 1):
            after = step[state].get(c)
            state = self.automaton.follow(state, c) if after is None else after
            top, start, piece = low, 0, -1
            for length, score, found in outputs[state] or self.automaton.outputs_of(state):
                score += best[i - length]
                if score > top:
                    top, start, piece = score, i - length, found
            if c not in singles and best[i - 1] + unknown_score > top:
                top, start, piece = best[i - 1] + unknown_score, i - 1, -1
            best[i], come[i], by[i] = top, start, piece
        out: list[int] = []
        at = n
        while at:
            if by[at] >= 0:
                out.append(by[at])
            elif self.bytes_known:
                out.extend(self.byte_ids[b] for b in reversed(unit[come[at] : at].encode("utf-8", "replace")))
            else:
                out.append(self.unknown)
            at = come[at]
        return array("i", reversed(out))

    def _chain(self, marked: str) -> array:
        """The ids of a stretch of marked text, unit by unit; short stretches are remembered."""
        ids = array("i")
        for unit in self.units.findall(marked):
            ids.extend(self.solve(unit))
        if len(marked) <= 64:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[marked] = ids
        return ids

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        known, chain = self.remembered, self._chain
        pending = 1 if self.vocabulary.prefix else 0
        if not self.safe:
            return chain(MARK * pending + text.replace(" ", MARK))
        for place, word in enumerate(text.split(" ")):
            pending += place > 0
            if word:
                marked = MARK + word if pending == 1 else MARK * pending + word
                out.extend(known.get(marked) or chain(marked))
                pending = 0
        if pending:
            out.extend(chain(MARK * pending))
        return out

    def decode(self, ids) -> str:
        table = self.table
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.prefix and text.startswith(" ") else text


def encoded_rows(encoder: Encoder, texts: pa.Array):
    """(first row, end, piece ids, round trips) of stretches of rows with a bounded number of ids."""
    first, size = 0, 0
    flat, offsets, same = array("i"), [0], []
    for end, value in enumerate(texts, 1):
        text = value.as_py() or ""
        ids = encoder.encode(text)
        flat.extend(ids)
        offsets.append(len(flat))
        same.append(encoder.decode(ids) == text)
        size += len(text)
        if len(flat) >= BATCH_IDS or size >= BATCH_CHARS or end == len(texts):
            values = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(values))
            yield first, end, ids, pa.array(same, pa.bool_())
            first, size = end, 0
            flat, offsets, same = array("i"), [0], []


def encode(docs: DataFrame, vocabulary: Vocabulary, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default), piece_ids, and round_trip: whether they decode to the text."""
    made = ("piece_ids", "round_trip")
    carry = [c for c in (carry or docs.columns) if c not in made]
    schema = T.StructType([docs.schema[c] for c in carry])
    schema = schema.add("piece_ids", T.ArrayType(T.IntegerType(), False)).add("round_trip", "boolean")
    # A text that is carried anyway goes to the tasks once.
    place = carry.index("text") if "text" in carry else len(carry)
    given = docs.select(*[f"`{c}`" for c in carry], *([] if place < len(carry) else [docs["text"].alias("__text")]))

    def encoded(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            for first, end, *found in encoded_rows(encoder, batch.column(place)):
                arrays = [*batch.slice(first, end - first).columns[: len(carry)], *found]
                yield pa.RecordBatch.from_arrays(arrays, [*carry, *made])

    return given.mapInArrow(giving_back(encoded), schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "piece_ids", into: str = "text") -> DataFrame:
    """All columns but ``ids``, with the decoded texts as the last column ``into``; null ids give null."""
    carry = [c for c in encoded.columns if c not in (ids, into)]
    schema = T.StructType([encoded.schema[c] for c in carry]).add(into, "string")
    given = encoded.select(*[f"`{c}`" for c in carry], encoded[ids].alias("__ids"))

    def decoded(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*carry, into])

    return given.mapInArrow(giving_back(decoded), schema)
