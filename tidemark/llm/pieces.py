"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch (runs of word-boundary marks with what follows, which no piece crosses) are
concatenated and indexed by a suffix array as deep as the longest piece. Every piece is looked up in it by
binary search; its range gives all its occurrences at once. The occurrences are edges over the text; sorted by
position they form a table of which spans are pieces, and relaxation joins neighbouring spans in the order
the model's scores give, until no edge spans two neighbours. Characters without a piece fall back to bytes.

Supported: BPE models with identity normalisation and byte fallback, which is what the relaxation order and
the decoder assume; any other model is refused. Defined results: a null text has null ids; an empty text has
no ids; texts are encoded whole, at any length; a literal U+2581 decodes as a space, as in the model's own rule.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, trim

MARK = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Characters of new words indexed at once, words kept for reuse, and the longest word relaxed with the others.
BLOCK_CHARS, KEPT_WORDS, LONG_WORD = 200_000, 150_000, 96


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PieceModel:
    """Pieces, scores and byte ids of a model file; small enough to travel with the function that uses it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(own.serialized_model_proto())
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only identity normalisation is supported")
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        self.pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        self.scores = np.array([own.get_score(i) for i in range(len(self.pieces))], dtype=np.float64)
        self.byte_id = np.zeros(256, dtype=np.int32)
        special = set()
        for i, piece in enumerate(self.pieces):
            if own.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            if own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                special.add(i)
        self.normal = [i for i in range(len(self.pieces)) if i not in special]
        if any(MARK in p.lstrip(MARK) for p in (self.pieces[i] for i in self.normal)):
            raise ValueError("a piece crosses a word boundary")
        self.unknown = own.unk_id()


def _pack(codes: np.ndarray, wide: bool) -> np.ndarray:
    """Rows of codes to big-endian machine words whose order is the rows' order."""
    raw = np.ascontiguousarray(codes.astype(">u2" if wide else "u1")).view("u1").reshape(len(codes), -1)
    return raw.view(">u8").astype(np.uint64)


class Encoder:
    def __init__(self, model: PieceModel):
        self.m = model
        self.depth = max(8, -(-max(len(model.pieces[i]) for i in model.normal) // 8) * 8)
        self.length = np.array([len(model.pieces[i]) for i in model.normal], dtype=np.int64)
        self.ids = np.array(model.normal, dtype=np.int32)
        flat = np.frombuffer("".join(model.pieces[i] for i in model.normal).encode("utf-32-le"), dtype=np.uint32)
        self.grid = np.zeros((len(model.normal), self.depth), dtype=np.uint32)
        self.grid[np.arange(self.depth)[None, :] < self.length[:, None]] = flat
        # Letters by number, 0 for characters that are in no piece, and the pieces in these numbers.
        alphabet = np.unique(flat)
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[alphabet] = np.arange(1, len(alphabet) + 1)
        self.n_letters = len(alphabet) + 1
        self.grid = self.letter[self.grid]
        self.inside = np.arange(self.depth)[None, :] < self.length[:, None]
        joined = "".join(p for p in (model.pieces[i] for i in model.normal) if len(p) > 1)
        # A line break that is in no longer piece ends a word, which makes words recur more often.
        self.split = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if "\n" not in joined else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        raw = [bytes([int(p[3:5], 16)]) if i in set(model.byte_id.tolist()) else p.encode() for i, p in enumerate(model.pieces)]
        raw[model.unknown] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_len = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = [], []
        self.csr = (np.zeros(0, np.int32), np.zeros(1, np.int64))

    # encoding

    def words(self, text: str) -> list[str]:
        marked = text.replace(" ", MARK)
        return self.split.findall(MARK + marked if self.m.prefix and marked else marked)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start and the last ends."""
        split = [self.words(t) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        index = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        absent = np.nonzero(index < 0)[0]
        missed = [words[i] for i in absent.tolist()]
        new = set(missed)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.reset()
            absent, missed, new = np.arange(len(words)), words, set(words)
        self._learn(new)
        index[absent] = np.fromiter(map(self.known.__getitem__, missed), np.int64, len(missed))
        flat, at = self.csr
        size = at[1:][index] - at[:-1][index]
        stops = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(at[:-1][index] - stops[:-1], size) + np.arange(stops[-1])]
        ends = np.cumsum([0] + [len(w) for w in split])
        return ids, stops[ends]

    def _learn(self, words: set[str]) -> None:
        if not words:
            return
        block, chars = [], 0
        for word in words:
            if len(word) > LONG_WORD:
                self._keep([word], self._index([word], whole=True))
                continue
            block.append(word)
            chars += len(word) + 1
            if chars > BLOCK_CHARS:
                self._keep(block, self._index(block))
                block, chars = [], 0
        if block:
            self._keep(block, self._index(block))
        sizes = np.concatenate(self.sizes)
        self.flat, self.sizes = [np.concatenate(self.flat)], [sizes]
        self.csr = (self.flat[0], np.concatenate([[0], np.cumsum(sizes)]))

    def _keep(self, words: list[str], found: tuple[np.ndarray, np.ndarray]) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.flat.append(found[0])
        self.sizes.append(found[1])

    def _index(self, words: list[str], whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        chars = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        stops = np.cumsum(lengths + 1) - 1
        starts = stops - lengths
        n = len(chars)
        letters = self.letter[chars]
        # Codes in this text: 0 between words, 1 for what is in no piece, the letters it has from 2 on.
        present = np.unique(letters[letters > 0])
        wide = len(present) > 253
        code = np.ones(self.n_letters, dtype=np.int64)
        code[present] = np.arange(2, len(present) + 2)
        codes = code[letters]
        codes[stops] = 0
        # The suffix array: suffixes by their first `depth` codes, which is as far as a piece can tell them apart.
        padded = np.concatenate([codes, np.zeros(self.depth, codes.dtype)]).astype(np.uint16 if wide else np.uint8)
        keys = _pack(np.lib.stride_tricks.sliding_window_view(padded, self.depth)[:n], wide)
        order = _sorted(keys)
        keys = keys[order]
        # Pieces made of letters of this text, as lower and upper bounds in the same order.
        own = code[self.grid]
        usable = np.nonzero(((own > 1) | ~self.inside).all(axis=1))[0]
        table = np.full(n * (self.depth + 1), -1, dtype=np.int32)
        if len(usable):
            inside = self.inside[usable]
            low, high = _pack(np.where(inside, own[usable], 0), wide), _pack(np.where(inside, own[usable], 65535 if wide else 255), wide)
            first, last = _search(keys, low, False), _search(keys, high, True)
            count = last - first
            total = np.concatenate([[0], np.cumsum(count)])
            place = order[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
            # Edges by position, then length, with the id in the low bits; spots of the table are in that order.
            edges = ((place * (self.depth + 1) + np.repeat(self.length[usable], count)) << 24) | np.repeat(self.ids[usable], count)
            edges.sort()
            table[edges >> 24] = edges & 0xFFFFFF
        table = table.reshape(n, self.depth + 1)
        if whole:
            ids = self._relax_long(words[0], table)
            return ids, np.array([len(ids)], dtype=np.int64)
        return self._relax(words, table, starts, stops, chars)

    def _relax(self, words, table, starts, stops, chars) -> tuple[np.ndarray, np.ndarray]:
        """Every round joins the best pair of each word, the leftmost of equals, until none has one."""
        n, scores = len(table), self.m.scores
        after = np.arange(1, n + 2)  # where the span that starts here ends
        word_of = np.repeat(np.arange(len(words)), stops - starts + 1)
        live = np.ones(n, dtype=bool)
        live[stops] = False
        at = np.nonzero(live)[0]  # starts of spans
        while len(at):
            here, word = at[:-1], word_of[at[:-1]]
            pair = word == word_of[at[1:]]
            left, right = here[pair], at[1:][pair]
            size = after[right] - left
            fits = size <= self.depth
            left, right, size = left[fits], right[fits], size[fits]
            piece = table[left, size]
            real = piece >= 0
            left, right, size, piece = left[real], right[real], size[real], piece[real]
            if not len(left):
                break
            word = word_of[left]
            score = scores[piece]
            begin = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
            best = np.maximum.reduceat(score, begin)
            group = np.cumsum(np.concatenate([[False], word[1:] != word[:-1]]))
            top = np.nonzero(score == best[group])[0]
            top = top[np.concatenate([[True], group[top][1:] != group[top][:-1]])]
            after[left[top]] = left[top] + size[top]
            live[right[top]] = False
            active = np.zeros(len(words), dtype=bool)
            active[word[top]] = True
            at = at[active[word_of[at]] & live[at]]
        at = np.nonzero(live)[0]
        ids = table[at, after[at] - at]
        owner = word_of[at]
        if (ids >= 0).all():
            return ids, np.bincount(owner, minlength=len(words))
        out, sizes = [], np.zeros(len(words), dtype=np.int64)
        for i, w, c in zip(ids.tolist(), owner.tolist(), chars[at].tolist(), strict=True):
            made = [i] if i >= 0 else self._bytes(c)
            out += made
            sizes[w] += len(made)
        return np.array(out, dtype=np.int32), sizes

    def _bytes(self, code: int) -> list[int]:
        return self.m.byte_id[list(chr(code).encode("utf-8", "replace"))].tolist()

    def _relax_long(self, word: str, table: np.ndarray) -> np.ndarray:
        """The same order by a heap, for a word with many joins."""
        n = len(word)
        scores = self.m.scores
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                size = after[right] - left
                if size <= self.depth and (piece := table[left, size]) >= 0:
                    heapq.heappush(heap, (-scores[piece], left, right, after[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, stop = heapq.heappop(heap)
            if not (alive[left] and right < n and alive[right] and after[left] == right and after[right] == stop):
                continue
            alive[right] = False
            after[left] = stop
            if stop < n:
                before[stop] = left
            offer(before[left], left)
            offer(left, stop)
        out: list[int] = []
        at = 0
        while at < n:
            piece = int(table[at, after[at] - at]) if after[at] - at <= self.depth else -1
            out += [piece] if piece >= 0 else self._bytes(ord(word[at]))
            at = after[at]
        return np.array(out, dtype=np.int32)

    # decoding

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the id runs between neighbouring places of `at`."""
        size = self.raw_len[ids]
        stops = np.concatenate([[0], np.cumsum(size)])
        raw = self.raw[np.repeat(self.raw_at[ids] - stops[:-1], size) + np.arange(stops[-1])].tobytes()
        cuts = stops[at].tolist()
        mark, out = MARK.encode(), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            text = raw[a:b].replace(mark, b" ").decode("utf-8", "replace")
            out.append(text[1:] if self.m.prefix and text.startswith(" ") else text)
        return out


def _sorted(keys: np.ndarray) -> np.ndarray:
    """Order of the rows. Most differ in their first word; only runs of equals are sorted by the others."""
    order = np.argsort(keys[:, 0])
    same = keys[order[1:], 0] == keys[order[:-1], 0]
    run = np.nonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))[0]
    if len(run):
        rows = order[run]
        order[run] = rows[np.lexsort(keys[rows].T[::-1])]
    return order


def _search(keys: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all wanted rows at once: how many keys are below each (upper: not above).

    The first word narrows the range; where further words matter, the search goes on within it.
    """
    head = np.ascontiguousarray(keys[:, 0])
    low, high = np.searchsorted(head, wanted[:, 0], "left"), np.searchsorted(head, wanted[:, 0], "right")
    # Padding alone is left: all of the range is above the lower bound and not above the upper one.
    rest = wanted[:, 1:]
    plain = (rest == (np.uint64(0xFFFFFFFFFFFFFFFF) if upper else np.uint64(0))).all(axis=1)
    out = np.where(plain, high if upper else low, low)
    more = np.nonzero(~plain & (low < high))[0]
    low, high = low[more], high[more]
    while (open_ := low < high).any():
        mid = (low + high) // 2
        probe = keys[np.minimum(mid, len(keys) - 1)]
        less, tie = np.zeros(len(more), bool), np.ones(len(more), bool)
        for k in range(1, keys.shape[1]):
            less |= tie & (probe[:, k] < wanted[more, k])
            tie &= probe[:, k] == wanted[more, k]
        right = open_ & (less | tie if upper else less)
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    out[more] = low
    return out


SCHEMA = "doc_id long, n_tokens int, n_byte_tokens int, ids array<int>, round_trip boolean"


def _encode_rows(model: PieceModel, block: int = 256):
    def run(batches):
        # What other queries left in this worker goes first.
        release()
        encoder = Encoder(model)
        is_byte = np.zeros(len(model.pieces), dtype=bool)
        is_byte[model.byte_id] = True
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                texts = part.column(1).to_pylist()
                ids, at = encoder.encode_batch(texts)
                back = encoder.decode_batch(ids, at)
                mask = np.array([t is None for t in texts], dtype=bool)
                byte_runs = np.concatenate([[0], np.cumsum(is_byte[ids])])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(mask, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(at).astype(np.int32), mask=mask),
                        pa.array((byte_runs[at[1:]] - byte_runs[at[:-1]]).astype(np.int32), mask=mask),
                        lists,
                        pa.array([None if t is None else t == b for t, b in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"],
                )
                del part, texts, ids, at, back, mask, byte_runs, lists
            del batch
            trim()
        del encoder
        release()

    return run


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids, round_trip) of every row; round_trip: decoding gives the text back."""
    model = PieceModel(path or model_path())
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode_rows(model), SCHEMA)


def _decode_rows(model: PieceModel):
    def run(batches):
        encoder = Encoder(model)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            at = np.cumsum([0] + [len(r or ()) for r in rows])
            ids = np.array([i for r in rows for i in r or ()], dtype=np.int64)
            texts = encoder.decode_batch(ids, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string())],
                names=["doc_id", "text"],
            )

    return run


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids."""
    model = PieceModel(path or model_path())
    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decode_rows(model), "doc_id long, text string")
