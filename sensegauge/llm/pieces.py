"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the pieces that end at each place of the text and keeps, for each place, the best path to it as a
backpointer. Only places within the longest piece of the current one can still be left by a piece, so the window is that
long; whenever the backpointer paths of all these places meet in one boundary, the ids before it are final and are
committed. The search's memory is that window, whatever the length of a text (where paths never meet, which no text of
the tests does, the window grows). A text and its ids are a row of the table, so these are in memory whole.

For a unigram model the best path is that with the highest sum of scores. The vocabulary at hand is a BPE model, whose
encoding is not the path with the best sum. There, a piece may follow another one only if merging their text alone gives
the two again; a text has just one path of such steps, and that is its BPE encoding. So the search has the same form,
with steps that are allowed or not instead of scores, and gives the library's ids.

Where a vocabulary has no piece that goes over two characters, such as a letter and the space or full stop after it, all
paths meet. Stretches between such places are words here. Every new word goes through the search; as many words come
again, the ids that it gave are remembered beside it, up to a bound.

Defined results: null and empty texts have no ids and decode to the empty text; very long texts and words are encoded
whole; repeated rows are encoded each; other columns are kept, but columns named ids or decoded are replaced; an empty
table gives no rows. Of unigram paths with equal scores the one whose last piece is longest stays. A U+2581 in a text
decodes as a space, as it does with the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensegauge.llm.kernels import map_arrow, slices, with_field

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words and pairs of pieces that are remembered at most.
WORDS, PAIRS = 200_000, 500_000
#: Longest word that is remembered.
SHORT = 64
#: The search looks for a common boundary after so many times the longest piece.
STEP = 4
#: Characters of a part of a text that is split into words at once, about.
CHUNK = 1 << 16


class Vocabulary:
    """Pieces, scores and kinds of a model; small, whatever the input."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], bytes_: dict[int, int], unknown: int, bpe: bool) -> None:
        self.pieces, self.scores, self.special, self.bytes, self.unknown, self.bpe = pieces, scores, special, bytes_, unknown, bpe

    @classmethod
    def read(cls, path: str = MODEL, bpe: bool = True) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        return cls(pieces, [sp.get_score(i) for i in range(n)], special, {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}, sp.unk_id(), bpe)


class Known(dict):
    """Ids by text: of the last WORDS new texts, and ``again`` of the WORDS before."""

    before: dict[str, bytes] = {}

    def again(self, text: str) -> bytes | None:
        return self.before.get(text)

    def add(self, text: str, ids: bytes) -> bytes:
        if len(text) <= SHORT:
            if len(self) >= WORDS:
                self.before = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Codec:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.ids = {p: i for i, p in enumerate(v.pieces) if i not in v.special}
        #: For each piece whether it may stand after a piece, as far as that has been asked.
        self.pairs: dict[int, dict[int, bool]] = {i: {} for i in self.ids.values()}
        self.n_pairs = 0
        self.root = self._automaton()
        self.longest = max(map(len, self.ids))
        self.window = 0  # places that the search has held at once, at most
        self.floor = min(v.scores) - 10
        self.words, self.tokens = Known(), Known()
        self.word, self.odd = self._words()
        self.space = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        back = {i: bytes([b]) for b, i in v.bytes.items()}
        self.out = [back.get(i, b"" if i in v.special else p.replace(SPACE, " ").encode()) for i, p in enumerate(v.pieces)]

    def _automaton(self) -> dict:
        """For what has been read last, as far as a piece goes on with it: by character the state after it. Under "" stand the
        pieces that end in a state, the longest first, with their lengths and what is known of pairs, and under None the state to go on from where a
        character leads nowhere (Aho and Corasick 1975), and under 0 how many characters it has."""
        root: dict = {"": (), None: None, 0: 0}
        for p, i in self.ids.items():
            state = root
            for char in p:
                state = state.setdefault(char, {"": (), None: root, 0: state[0] + 1})
            state[""] = ((i, len(p), self.pairs[i]),)
        level = [state for char, state in root.items() if char]
        while level:  # shorter states are done first
            further = []
            for state in level:
                for char, after in state.items():
                    if char:
                        shorter = state[None]
                        while shorter is not None and char not in shorter:
                            shorter = shorter[None]
                        after[None] = root if shorter is None else shorter[char]
                        after[""] += after[None][""]
                        further.append(after)
            level = further
        return root

    def _words(self) -> tuple[re.Pattern | None, re.Pattern | None]:
        """Splits text where no piece goes on: before a space after something else, and before a sign after what is no
        sign. Also finds the few pairs of characters that some piece has there nevertheless; texts with these are split
        at spaces only. None for a vocabulary whose pieces have spaces inside."""
        before: dict[str, set[str]] = {c: set() for p in self.ids for c in p}
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                before[y].add(x)
        if before.get(SPACE, set()) - {SPACE}:
            return None, None
        signs = {c for c in before if not c.isalnum() and c != SPACE} | set("\n\r\t")
        while more := {c for c in signs if len(before.get(c, set()) - signs - {SPACE}) > 2}:
            signs -= more
        odd = [re.escape(x + c) for c in sorted(signs) for x in before.get(c, set()) - signs - {SPACE}]
        listed = "".join(map(re.escape, sorted(signs)))
        return re.compile(f"{SPACE}*[{listed}]*[^{SPACE}{listed}]+|{SPACE}+[{listed}]*|[{listed}]+"), re.compile("|".join(odd)) if odd else None

    def merge(self, text: str) -> list[str]:
        """BPE from characters: the pair that makes the piece with the best score first, the leftmost of equal ones."""
        parts = list(text)
        ids, scores = self.ids, self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or scores[j] > best):
                    best, at = scores[j], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may stand after piece a (-1: after none)."""
        known = self.pairs[b].get(a)
        if known is None:
            if self.n_pairs >= PAIRS:
                for pairs in self.pairs.values():
                    pairs.clear()
                self.n_pairs = 0
            parts = [self.v.pieces[x] for x in (a, b) if x >= 0]
            known = self.pairs[b][a] = self.merge("".join(parts)) == parts
            self.n_pairs += 1
        return known

    def search(self, text: str, start: int = 0, stop: int | None = None) -> Iterator[list[int]]:
        """Ids of a part of normalised text, in lists, as they become final.

        The window begins at ``base``, the last place that is known to be on the best path. After each ``STEP`` times the
        longest piece, the places that later pieces can begin at are followed back until they meet; what is before is
        final, and the window moves there."""
        stop = len(text) if stop is None else stop
        root, longest, bpe, scores, floor, worst, state = self.root, self.longest, self.v.bpe, self.v.scores, self.floor, float("-inf"), self.root
        # for place base + k: id of the piece that ends there (-1: unknown character, or the beginning), where that piece
        # begins, and for unigram models the score of the path
        base, at, last, back, best = start, start, [-1], [start - 1], [0.0]
        while at < stop:
            end = min(stop, at + STEP * longest)
            size = len(last)
            last.extend([-1] * (end - base + 1 - size))
            back.extend(range(base + size - 1, end))
            if not bpe:
                best.extend([worst] * (end - base + 1 - size))
            for j, char in enumerate(text[at:end], at - base + 1):
                while (after := state.get(char)) is None:
                    if state is root:
                        after = root
                        break
                    state = state[None]
                state = after
                if bpe:
                    for piece, n, known in state[""]:
                        if n <= j and (ok := known.get(last[j - n])) is not False and (ok or self.follows(last[j - n], piece)):
                            last[j], back[j] = piece, base + j - n
                            break
                else:
                    for piece, n, _ in state[""]:
                        if n <= j and best[j - n] + scores[piece] > best[j]:
                            last[j], back[j], best[j] = piece, base + j - n, best[j - n] + scores[piece]
                    if best[j - 1] + floor > best[j] and char not in self.ids:
                        last[j], back[j], best[j] = -1, base + j - 1, best[j - 1] + floor
            if len(last) > self.window:
                self.window = len(last)
            # places that pieces which end later can begin at; all later paths go through one of them
            meet = end
            if end < stop:
                live, going = {end}, state
                while going is not root:
                    live.add(max(base, end - going[0]))
                    going = going[None]
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(back[top - base])
                (meet,) = live
            ids, p = [], meet
            while p > base:
                piece, before = last[p - base], back[p - base]
                ids.extend((piece,) if piece >= 0 else reversed(self.unknown(text[before:p])))
                p = before
            ids.reverse()
            if ids:
                yield ids
            del last[: meet - base], back[: meet - base], best[: meet - base]
            base, at = meet, end

    def unknown(self, char: str) -> list[int]:
        return [self.v.bytes[b] for b in char.encode()] if self.v.bytes else [self.v.unknown]

    def coded(self, text: str) -> Iterator[bytes]:
        """Ids of a text as 32-bit integers, by parts of the text of about CHUNK characters. Beside the text and its ids, no
        more than a part and the search's window is in memory."""
        if self.word is None:
            yield from (array("i", ids).tobytes() for ids in self.search(SPACE + text.replace(" ", SPACE)))
            return
        at = 0
        while at < len(text):
            cut = text.find(" ", at + CHUNK)
            while cut != -1 and (text[cut - 1] in (" ", SPACE)):
                cut = text.find(" ", cut + 1)
            cut = len(text) if cut == -1 else cut
            part = text[at:cut] if at == 0 else text[at + 1 : cut]  # all parts but the first begin with a space
            if part.startswith(" ") or "  " in part or SPACE in part:  # runs of spaces are pieces too
                yield from self.of_stretch(SPACE + part.replace(" ", SPACE))
            else:
                tokens = part.split(" ")
                found = list(map(self.tokens.get, tokens))
                for i in [i for i, ids in enumerate(found) if ids is None]:
                    token = tokens[i]
                    ids = self.tokens.get(token) or self.tokens.again(token)
                    if not ids:  # letters and digits alone are one word
                        ids = self.found(SPACE + token) if token.isalnum() else b"".join(self.of_stretch(SPACE + token))
                    found[i] = self.tokens.add(token, ids)
                yield b"".join(found)
            at = cut

    def found(self, word: str) -> bytes:
        return b"".join(array("i", ids).tobytes() for ids in self.search(word))

    def encode(self, text: str) -> bytes:
        return b"".join(self.coded(text))

    def of_stretch(self, text: str) -> Iterator[bytes]:
        """Ids of the words of normalised text: what is remembered, or else found by the search."""
        for m in (self.space if self.odd is not None and self.odd.search(text) else self.word).finditer(text):
            if m.end() - m.start() > SHORT:
                yield from (array("i", ids).tobytes() for ids in self.search(text, m.start(), m.end()))
                continue
            w = m.group()
            known, key = (self.tokens, w[1:]) if w[0] == SPACE and len(w) > 1 and w[1] != SPACE else (self.words, w)
            ids = known.get(key) or known.again(key) or self.found(w)
            yield known.add(key, ids)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict = {}


def codec(sent) -> Codec:
    """The codec of a vocabulary that was shipped; built once in each Python worker, with what it remembers."""
    vocabulary = sent.value
    if _CODECS.get("vocabulary") is not vocabulary:
        _CODECS.update(vocabulary=vocabulary, codec=Codec(vocabulary))
    return _CODECS["codec"]


def ship(spark, vocabulary: Vocabulary):
    """The vocabulary, of some megabytes whatever the input, for ``encode`` and ``decode``."""
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, sent, decoded: bool = False) -> DataFrame:
    """docs with ``ids``, and with ``decoded``, the text that these ids give, if asked for. sent: a broadcast Vocabulary.
    docs: doc_id, text, and others that are kept."""

    docs = docs.drop("ids", *["decoded"] * decoded)

    def run(batches):
        own = codec(sent)
        for part in (p for b in batches for p in slices(b)):
            coded = [own.encode(t.as_py() or "") for t in part.column("text")]
            offsets = np.append(0, np.cumsum([len(c) // 4 for c in coded])).astype(np.int32)
            columns = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))]
            if decoded:
                columns.append(pa.array([own.decode(memoryview(c).cast("i")) for c in coded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "ids", *["decoded"] * decoded])

    return map_arrow(docs, run, with_field(docs.schema, "ids array<int>, decoded string" if decoded else "ids array<int>"))


def decode(encoded: DataFrame, sent) -> DataFrame:
    """encoded (with ids) with ``decoded``."""
    encoded = encoded.drop("decoded")

    def run(batches):
        own = codec(sent)
        for batch in batches:
            texts = [own.decode(x.values.to_numpy() if x.is_valid else []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return map_arrow(encoded, run, with_field(encoded.schema, "decoded string"))
