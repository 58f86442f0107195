"""SentencePiece encoding and decoding of texts of any length by a max-plus scan over chunks.

A pair of neighbouring pieces weighs 0 if merging their joint text by score gives just that pair again, and minus
infinity if not; a sequence of pieces is the encoding of its text exactly if no pair of it weighs minus infinity. So the
encoding is the best path through (position, last piece), and for every position there is at most one.

A giant text is cut into chunks. The state at a cut is the piece that reaches it and how far it reaches beyond. Each
chunk yields its transfer matrix between the states at its two cuts, kept as the list of its entries of weight 0; these
matrices are combined by an associative product, which gives every chunk the state it is entered and left by on the
one path of the whole text, and each chunk then traces its own pieces back. Between a mark of white space and a piece
before it that is none, no piece can reach across, so all states agree there: chunks that have such a place need no more
than the pieces around their cuts, and what lies between is encoded word by word. Shorter texts are single chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from larderflow.session import written

MARK = "▁"
# Characters of a chunk; longer texts are cut.
CHUNK = 1 << 16
# Words whose ids a task remembers, and as many of those used before them.
KNOWN_WORDS = 100_000
# Texts worked on at a time.
ROWS = 256
TABLE_BITS = 20
State = tuple[int, str]  # how far the last piece reaches beyond the cut, and the piece


class Pieces:
    """The pieces of a model file: BPE with byte fallback, white space written as a mark, a mark put before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        self.ids = {model.id_to_piece(k): k for k in normal}
        self.scores = {p: model.get_score(k) for p, k in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = {int(model.id_to_piece(k)[3:5], 16): k for k in range(size) if model.is_byte(k)}
        self.said = [b""] * size  # by id: the bytes it stands for; none for control pieces
        for piece, k in self.ids.items():
            self.said[k] = piece.replace(MARK, " ").encode()
        for value, k in self.bytes.items():
            self.said[k] = bytes([value])
        self._weights: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._slots: np.ndarray | None = None

    def _prepare_merges(self) -> None:
        """Arrays for merging many words at once: ids of characters, and an open hash table from pairs to their piece."""
        self._letters = -2 - np.arange(0x110000, dtype=np.int32)  # a character without a piece: -2 less its code
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self._letters[ord(piece)] = k
        order = {score: n for n, score in enumerate(sorted(set(self.scores.values())))}
        self._ranks = np.full(len(self.said) + 1, -1, np.int32)  # the last is for no piece
        for piece, k in self.ids.items():
            self._ranks[k] = order[self.scores[piece]]
        pairs = {}
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = k
        self._slots = np.full((1 << TABLE_BITS, 2), -1, np.int64)  # many times as many as pairs
        taken: set[int] = set()
        places = []
        for slot in self._slot(np.fromiter(pairs, np.int64)).tolist():
            while slot in taken:
                slot = (slot + 1) % (1 << TABLE_BITS)
            taken.add(slot)
            places.append(slot)
        self._slots[places, 0], self._slots[places, 1] = list(pairs), list(pairs.values())

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _merged_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, -1 for none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) << 20 | right, -2)
        slot = self._slot(key)
        held = self._slots[slot, 0]
        odd = np.nonzero((held != key) & (held >= 0) & (key >= 0))
        while len(odd[0]):  # taken by another pair: look on
            slot[odd] = (slot[odd] + 1) % (1 << TABLE_BITS)
            held[odd] = self._slots[slot[odd], 0]
            again = (held[odd] != key[odd]) & (held[odd] >= 0)
            odd = tuple(o[again] for o in odd)
        return np.where(held == key, self._slots[slot, 1], -1).astype(np.int32)

    def merged_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of many short words, merged side by side: in each round every word merges its best pair, ties from the left."""
        if self._slots is None:
            self._prepare_merges()
        sizes = np.array([len(w) for w in words])
        letters = self._letters[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        parts = np.full((len(words), sizes.max(initial=1) + 1), -1, np.int32)
        parts[np.arange(parts.shape[1])[None] < sizes[:, None]] = letters
        active = np.flatnonzero(sizes > 1)
        columns = np.arange(parts.shape[1] - 1)
        own = parts[active]
        pairs = self._merged_pairs(own[:, :-1], own[:, 1:])
        while len(active):
            ranks = self._ranks[pairs]
            best = ranks.argmax(1)
            rows = np.flatnonzero(ranks[np.arange(len(best)), best] >= 0)
            parts[active] = own
            active, own, best, pairs = active[rows], own[rows], best[rows], pairs[rows]
            at = np.arange(len(best))
            own[at, best] = pairs[at, best]
            source = columns[None] + (columns[None] > best[:, None])
            own[:, :-1] = np.take_along_axis(own, source, 1)
            own[:, -1] = -1
            pairs[:, :-1] = np.take_along_axis(pairs, source[:, :-1], 1)
            pairs[:, -1] = -1
            before = np.maximum(best - 1, 0)  # only the pairs on both sides of the new piece are new
            pairs[at, before] = self._merged_pairs(own[at, before], own[at, before + 1])
            pairs[at, best] = self._merged_pairs(own[at, best], own[at, best + 1])
        kept = (parts != -1).sum(1).tolist()
        odd = (parts < -1).any(1).tolist()
        out = []
        for row, n, strange in zip(parts.tolist(), kept, odd, strict=True):
            if strange:
                spelt = [[k] if k >= 0 else [self.bytes[b] for b in chr(-2 - k).encode("utf-8", "surrogatepass")] for k in row[:n]]
                out.append(tuple(k for some in spelt for k in some))
            else:
                out.append(tuple(row[:n]))
        return out

    def learn(self, spans: set[str]) -> None:
        """Remember the ids of spans as ``encode_texts`` cuts them: words, those behind a line feed with it in front."""
        if len(self.known) > KNOWN_WORDS:
            self._older, self.known = self.known, {}
        older = self._older
        new = []
        for s in spans.difference(self.known):
            if s in older:  # words still in use stay known
                self.known[s] = older[s]
            else:
                new.append(s)
        feed = tuple(self.numbered(["\n"]))
        lengths: dict[int, list[str]] = {}
        for s in new:
            lengths.setdefault(min(len(s), 25), []).append(s)
        for length, some in lengths.items():
            for start in range(0, len(some), 20_000):
                piece = some[start : start + 20_000]
                words = [s[1:] if s[0] == "\n" else MARK + s for s in piece]
                ids = self.merged_words(words) if length < 25 else [self.word(w) for w in words]
                self.known.update(zip(piece, ids, strict=True))
        for s in new:
            if s[0] == "\n":
                self.known[s] = feed + self.known[s]

    def merged(self, text: str) -> list[str]:
        """Characters merged by highest score, ties from the left."""
        parts = list(text)
        while len(parts) > 1:
            best, place = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, k
            if best is None:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether the pair weighs 0; the empty piece is the beginning of a text."""
        if not a or a not in self.ids or b not in self.ids or (a[-1] != MARK and b[0] == MARK):
            return True
        key = (a, b)
        if key not in self._weights:
            if len(self._weights) > 1_000_000:
                self._weights.clear()
            self._weights[key] = self.merged(a + b) == [a, b]
        return self._weights[key]

    def path(self, text: str, entry: State, end: int, cut: int) -> list[str | None]:
        """Last piece by position, from ``entry`` on up to ``end``; pieces begin before ``cut``."""
        last: list[str | None] = [None] * (end + 1)
        if entry[0] <= end:
            last[entry[0]] = entry[1]
        self.advance(text, last, entry[0] + 1, end, entry[0], cut)
        return last

    def advance(self, text: str, last: list[str | None], start: int, end: int, low: int, cut: int) -> None:
        for i in range(start, end + 1):
            for length in range(1, min(self.longest, i - low) + 1):
                before = last[i - length]
                if before is None or i - length >= cut:
                    continue
                piece = text[i - length : i]
                if (length == 1 or piece in self.ids) and self.fits(before, piece):
                    last[i] = piece
                    break

    def traced(self, last: list[str | None], end: int, entry: int) -> list[str]:
        out = []
        while end > entry:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def numbered(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            k = self.ids.get(p)
            out += [k] if k is not None else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a text that no piece reaches into or out of."""
        found = self._words.get(text)
        if found is None:
            if len(text) <= 24:
                pieces = self.merged(text)
            else:
                pieces = self.traced(self.path(text, (0, ""), len(text), len(text)), len(text), 0)
            found = tuple(self.numbered(pieces))
            if len(text) <= 64:
                if len(self._words) >= KNOWN_WORDS:
                    self._words.clear()
                self._words[text] = found
        return found


_WORD = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+(?=\n|$)")
_BREAK = re.compile(f"(?<=[^{MARK}])(?={MARK})")


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def encode_text(pieces: Pieces, text: str) -> list[int]:
    """Ids of a text in one piece of work."""
    out: list[int] = []
    extend, word, known = out.extend, pieces.word, pieces._words
    if "\n" in pieces.ids:  # then a line feed does not part words
        spans = _BREAK.split(marked(text))
    else:
        spans = _WORD.findall(marked(text))
    for span in spans:
        extend(known.get(span) or word(span))
    return out


def encode_texts(pieces: Pieces, texts: list[str]) -> list[np.ndarray]:
    """Ids of several texts. Words that are new are merged together; a text with runs of spaces or marks goes by itself."""
    cut: list[list[str] | None] = []
    for text in texts:
        spans = text.replace("\n", " \n").split(" ") if text and MARK not in text and "\n" not in pieces.ids else None
        cut.append(None if spans is None or "" in spans else spans)
    pieces.learn(set().union(*[c for c in cut if c]))
    known = pieces.known
    return [
        np.array(encode_text(pieces, text), np.int32) if spans is None
        else np.fromiter(chain.from_iterable(map(known.__getitem__, spans)), np.int32)
        for text, spans in zip(texts, cut, strict=True)
    ]


class Chunk:
    """One chunk of a marked text with the characters a piece may reach to on either side."""

    def __init__(self, pieces: Pieces, before: str, text: str, after: str) -> None:
        self.pieces, self.before, self.size, self.all = pieces, before, len(text), text + after
        breaks = [m.start() for m in _BREAK.finditer(before[-1:] + self.all)]
        breaks = [b - len(before[-1:]) for b in breaks]
        self.breaks = [b for b in breaks if 0 <= b <= self.size]

    def entries(self) -> list[State]:
        """All states a path may enter by: pieces that begin before the chunk and end in it or at its beginning."""
        if not self.before:
            return [(0, "")]
        out = []
        for beyond in range(min(self.pieces.longest, len(self.all) + 1)):
            for back in range(1, min(self.pieces.longest - beyond, len(self.before)) + 1):
                piece = self.before[-back:] + self.all[:beyond]
                if piece in self.pieces.ids or (back == 1 and not beyond):
                    out.append((beyond, piece))
        return out

    def _exits(self, last: list[str | None]) -> list[State]:
        return [(i - self.size, last[i]) for i in range(self.size, len(last)) if last[i] is not None and i - len(last[i]) < self.size]

    def transfer(self) -> dict[State, list[State]]:
        """The states that each entry leads to with weight 0."""
        end = min(len(self.all), self.size + self.pieces.longest - 1)
        if self.breaks:
            first, final = self.breaks[0], self.breaks[-1]
            if final == self.size:
                tail = None
            else:
                tail = self._exits(self.pieces.path(self.all, (final, ""), end, self.size))
            out = {}
            for entry in self.entries():
                if entry[0] > first:
                    continue
                last = self.pieces.path(self.all[:first], entry, first, first)
                if last[first] is None:
                    continue
                if tail is not None:
                    out[entry] = tail
                else:
                    out[entry] = [(0, self._last_before(entry, first, final, last))]
            return out
        return self._unbroken(end)

    def _last_before(self, entry: State, first: int, final: int, last: list[str | None]) -> str:
        """The piece that ends at the break ``final``."""
        if first == final:
            return last[first]
        start = self.breaks[-2]
        return self.pieces.path(self.all, (start, ""), final, final)[final]

    def _unbroken(self, end: int) -> dict[State, list[State]]:
        """Without a break each entry has a path of its own, until the last pieces of two paths agree all along a reach."""
        reach, step = self.pieces.longest, 256
        groups: list[tuple[list[State], list[str | None]]] = [([e], [None] * (end + 1)) for e in self.entries()]
        for (entry,), last in groups:
            if entry[0] <= end:
                last[entry[0]] = entry[1]
        for start in range(0, end, step):
            stop = min(start + step, end)
            joined: dict[tuple, tuple[list[State], list[str | None]]] = {}
            for entries, last in groups:
                low = entries[0][0] if len(entries) == 1 else 0
                self.pieces.advance(self.all, last, max(start, low) + 1, stop, low, self.size)
                held = joined.setdefault(tuple(last[max(0, stop - reach) : stop + 1]), (entries, last))
                if held[0] is not entries:
                    held[0].extend(entries)
            groups = list(joined.values())
        return {e: exits for entries, last in groups if (exits := self._exits(last)) for e in entries}

    def trace(self, entry: State, leave: State) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the path from ``entry`` to ``leave``."""
        end = self.size + leave[0]
        if not self.breaks or entry[0] > self.breaks[0]:
            return self.pieces.numbered(self.pieces.traced(self.pieces.path(self.all, entry, end, self.size), end, entry[0]))
        first, final = self.breaks[0], self.breaks[-1]
        head = self.pieces.traced(self.pieces.path(self.all[:first], entry, first, first), first, entry[0])
        out = self.pieces.numbered(head)
        for a, b in zip(self.breaks, self.breaks[1:], strict=False):
            out += self.pieces.word(self.all[a:b])
        if end > final:
            out += self.pieces.numbered(self.pieces.traced(self.pieces.path(self.all, (final, ""), end, self.size), end, final))
        return out


def product(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices of weights 0: the states that entries of ``a`` lead to through ``b``."""
    out = {}
    for entry, exits in a.items():
        reached = {leave: None for middle in exits for leave in b.get(middle, ())}
        if reached:
            out[entry] = list(reached)
    return out


def states(transfers: list[dict]) -> list[tuple[State, State]]:
    """Entry and exit of each chunk on the path that ends where the text does.

    Products of ever longer stretches are built as a tree (an associative scan); then each stretch hands its two states
    down to its halves.
    """

    def build(low: int, high: int):
        if high - low == 1:
            return transfers[low], None, None
        middle = (low + high) // 2
        left, right = build(low, middle), build(middle, high)
        return product(left[0], right[0]), left, right

    out: list[tuple[State, State]] = []

    def hand_down(node, entry: State, leave: State) -> None:
        _, left, right = node
        if left is None:
            out.append((entry, leave))
            return
        middle = next(m for m in left[0][entry] if leave in right[0].get(m, ()))
        hand_down(left, entry, middle)
        hand_down(right, middle, leave)

    tree = build(0, len(transfers))
    entry = (0, "")
    hand_down(tree, entry, next(s for s in tree[0][entry] if s[0] == 0))
    return out


def _packed_state(state: State) -> str:
    return f"{state[0]} {state[1]}"


def _state(packed: str) -> State:
    beyond, _, piece = packed.partition(" ")
    return int(beyond), piece


def encode(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows (id, ``text_key``, ``copies``, ``chunks``, ``chunk``, ``ids``): the piece ids of each text, a row for each chunk.

    Texts of up to ``chunk`` characters have one row; a null or empty text has one without ids. Longer ones have a row for
    each chunk of their text with the ids of the pieces that begin there; ``text_key`` (a digest of the text) tells rows
    with equal ids apart, and repeated rows of giant texts are encoded once, ``copies`` being their number (1 for others). Rows
    with null ids are encoded like others. Ids equal those of the model's own library. Other columns are not read; an
    empty table gives no rows. ``model`` is the path of the model file, readable by all executors.
    """
    short, giant = _encoded(docs, model, id, text, chunk)
    return short.unionAll(giant)


def _encoded(docs: DataFrame, model: str, id: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The rows of texts that are one chunk, and those of longer ones."""
    kind = docs.schema[id].dataType.simpleString()
    told = docs.select(F.col(id), F.col(text).alias("_text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    giant = F.length("_text") > chunk
    schema = f"{id} {kind}, text_key string, copies long, chunks long, chunk long, ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for whole_batch in batches:
            for start in range(0, len(whole_batch), ROWS):
                batch = whole_batch.slice(start, ROWS)
                ids = encode_texts(pieces, [t or "" for t in batch.column(1).to_pylist()])
                n = len(ids)
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))
                yield pa.record_batch(
                    [batch.column(0), batch.column(2), *[pa.array(np.full(n, v, np.int64)) for v in (1, 1, 0)], lists],
                    [id, "text_key", "copies", "chunks", "chunk", "ids"],
                )

    short = told.filter(~F.coalesce(giant, F.lit(False))).mapInArrow(whole, schema)
    return short, _encode_giant(told.filter(giant), model, id, chunk)


def _encode_giant(told: DataFrame, model: str, id: str, size: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces_of(model).longest
        for batch in batches:
            for row in range(len(batch)):
                key, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                said = marked(text)
                for k, at in enumerate(range(0, len(said), size)):
                    yield pa.record_batch(
                        [pa.array([v]) for v in (key, k, said[max(0, at - reach) : at], said[at : at + size], said[at + size : at + size + reach])],
                        ["text_key", "chunk", "before", "body", "after"],
                    )

    copies = told.groupBy(id, "text_key").agg(F.count("*").alias("copies"))
    texts = told.select("text_key", "_text").dropDuplicates(["text_key"])
    chunks = texts.mapInArrow(cut, "text_key string, chunk long, before string, body string, after string")
    chunks = written(chunks.repartition("text_key", "chunk"), "chunks")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for row in batch.to_pylist():
                found = Chunk(pieces, row["before"], row["body"], row["after"]).transfer()
                pairs = [(_packed_state(a), _packed_state(b)) for a, exits in found.items() for b in exits]
                yield pa.record_batch(
                    [pa.array([row["text_key"]]), pa.array([row["chunk"]]), pa.array([[p[0] for p in pairs]]), pa.array([[p[1] for p in pairs]])],
                    ["text_key", "chunk", "entries", "exits"],
                )

    def scan(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").to_pylist()
        transfers = []
        for row in rows:
            found: dict[State, list[State]] = {}
            for a, b in zip(row["entries"], row["exits"], strict=True):
                found.setdefault(_state(a), []).append(_state(b))
            transfers.append(found)
        path = states(transfers)
        return pa.table(
            {
                "text_key": [r["text_key"] for r in rows], "chunks": [len(rows)] * len(rows), "chunk": [r["chunk"] for r in rows],
                "entry": [_packed_state(a) for a, _ in path], "leave": [_packed_state(b) for _, b in path],
            }
        )

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for row in batch.to_pylist():
                one = Chunk(pieces, row["before"], row["body"], row["after"])
                ids = one.trace(_state(row["entry"]), _state(row["leave"]))
                yield pa.record_batch(
                    [*[pa.array([row[k]]) for k in ("text_key", "chunks", "chunk")], pa.array([ids], pa.list_(pa.int32()))],
                    ["text_key", "chunks", "chunk", "ids"],
                )

    transfers = chunks.mapInArrow(transfer, "text_key string, chunk long, entries array<string>, exits array<string>")
    scanned = transfers.groupBy("text_key").applyInArrow(scan, "text_key string, chunks long, chunk long, entry string, leave string")
    traced = chunks.join(scanned, ["text_key", "chunk"]).mapInArrow(trace, "text_key string, chunks long, chunk long, ids array<int>")
    return copies.join(traced, "text_key").select(F.col(id), "text_key", "copies", "chunks", "chunk", "ids")


def decode_ids(pieces: Pieces, ids: list[int], begins: bool = True) -> bytes:
    """The bytes that ids stand for; at the beginning of a text the mark put before it is left out."""
    out = b"".join([pieces.said[k] for k in ids])
    return out[1:] if begins and out[:1] == b" " else out


def decode(encoded: DataFrame, model: str, ids: str = "ids", chunk: str = "chunk") -> DataFrame:
    """``encoded`` with the column ``bytes``: the UTF-8 bytes that the ids of each row stand for.

    The bytes of a text's rows in the order of their chunks are the text, but for white space marks that the text itself
    held, which come back as spaces. Null ids give no bytes. Rows are independent, so nothing is shuffled.
    """
    at, place = encoded.columns.index(ids), encoded.columns.index(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for whole_batch in batches:
            for start in range(0, len(whole_batch), ROWS):
                batch = whole_batch.slice(start, ROWS)
                rows = zip(batch.column(place).to_pylist(), batch.column(at), strict=True)
                said = [decode_ids(pieces, found.values.to_numpy().tolist() if found.is_valid else [], k == 0) for k, found in rows]
                yield pa.record_batch([*batch.columns, pa.array(said, pa.binary())], [*batch.schema.names, "bytes"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("bytes", BinaryType())]))


def round_trips(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids_hash`` (of all ids in order) and ``round_trip``, whether decoding
    the ids gives the text again (not so for texts that hold a white space mark). See ``encode`` for odd rows."""
    whole, cut = (decode(rows, model) for rows in _encoded(docs, model, id, text, chunk))  # each text is encoded once
    n, hashed = F.size("ids").cast("long"), F.xxhash64("ids")
    short = whole.select(
        id, n.alias("n_tokens"), hashed.alias("ids_hash"), (F.md5("bytes") == F.col("text_key")).alias("round_trip"), "copies"
    )
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.col("bytes").alias("said"), hashed.alias("hashed"))))
    long = cut.groupBy(id, "text_key", "copies").agg(F.sum(n).alias("n_tokens"), parts.alias("parts"))
    said = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.said))
    long = long.select(
        id, "n_tokens", F.xxhash64("parts.hashed").alias("ids_hash"), (F.md5(said) == F.col("text_key")).alias("round_trip"), "copies"
    )
    both = short.unionAll(long).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return both.select(id, "n_tokens", "ids_hash", "round_trip")
