"""Byte-level BPE: model, exact encoding, decoding, training.

Ids 0-255 are the bytes, then come the special tokens, then one id per merge. Encoding never yields a special
token and never splits the text beforehand: the adjacent pair of the lowest rank is merged everywhere, from left to
right, until no pair is left.

Large texts go through the ``tokenizers`` library where it is installed and the model's tokens are distinct byte
strings; there its result is the same. Otherwise a linked-list encoder does the work in O(n log n)."""

from __future__ import annotations

import heapq
import json
from array import array
from collections import defaultdict
from collections.abc import Iterable, Sequence
from pathlib import Path

import numpy as np

from quillmill.functions.shingles import steps

try:
    import tokenizers as _tokenizers
except ImportError:
    _tokenizers = None

# The reserved markers in the order of their ids.
SPECIAL_TOKENS = ("<bos>", "<eos>", "<pad>", "<system>", "<user>", "<assistant>", "<tool_call>", "<tool_result>")
#: Name and version of the model files written here; files of other tools that end in the same kind are read too.
FORMAT, VERSION, KIND = "byte-level-bpe", 1, "-bpe"
BYTES = 256
#: Ids that one step of training looks at.
STEP_IDS = 500_000


def _printable() -> list[str]:
    """A distinct printable character for each byte, as byte-level BPE files write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class BpeModel:
    """Merges in rank order over bytes and special tokens."""

    def __init__(self, merges: Iterable[tuple[int, int]], special_tokens: Sequence[str] = SPECIAL_TOKENS) -> None:
        self.special_tokens = list(special_tokens)
        self.merges = [(int(a), int(b)) for a, b in merges]
        if len(set(self.special_tokens)) != len(self.special_tokens):
            raise ValueError("special tokens must be distinct")
        first = BYTES + len(self.special_tokens)
        self.piece: dict[int, bytes] = {b: bytes([b]) for b in range(BYTES)}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(self.merges):
            if a not in self.piece or b not in self.piece:
                raise ValueError(f"merge {rank} names an unknown id: {(a, b)}")
            self.piece[first + rank] = self.piece[a] + self.piece[b]
            self.rank.setdefault((a, b), rank)
        self.first = first
        self._fast = None

    @property
    def vocab_size(self) -> int:
        return self.first + len(self.merges)

    def special_id(self, token: str) -> int:
        """Id of a special token; KeyError if there is none of that name."""
        if token not in self.special_tokens:
            raise KeyError(token)
        return BYTES + self.special_tokens.index(token)

    def _library(self):
        if self._fast is None:
            self._fast = False
            if _tokenizers is not None and len(set(self.piece.values())) == len(self.piece):
                shown = _printable()
                names = {i: "".join(shown[x] for x in p) for i, p in self.piece.items()}
                model = _tokenizers.models.BPE(vocab={n: i for i, n in names.items()}, merges=[(names[a], names[b]) for a, b in self.merges], cache_capacity=0)
                self._fast = _tokenizers.Tokenizer(model)
                self._fast.pre_tokenizer = _tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return self._fast

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_fast": None}

    def encode(self, text: str) -> list[int]:
        """Token ids of ``text``."""
        fast = self._library() if len(text) > 64 else None
        return fast.encode(text, add_special_tokens=False).ids if fast else self.encode_bytes(text.encode("utf-8"))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        fast = self._library()
        if not fast:
            return [self.encode(t) for t in texts]
        # The library holds about a hundred bytes for each token until the numbers are taken: steps bound that.
        return [e.ids for lo, hi in steps(texts) for e in fast.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        fast = self._library()
        if not fast:
            return [len(self.encode(t)) for t in texts]
        return [len(e) for lo, hi in steps(texts) for e in fast.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]

    def token_count(self, text: str) -> int:
        return len(self.encode(text))

    def encode_bytes(self, data: bytes) -> list[int]:
        """Encoding without the library: a linked list of tokens and a heap of mergeable pairs."""
        n = len(data)
        ids, left, right = list(data), list(range(-1, n - 1)), [*range(1, n), -1] if n else []
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.first + rank, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (ids[x], ids[y]) in self.rank:
                    heapq.heappush(heap, (self.rank[ids[x], ids[y]], x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of token ids; ValueError for an id that isn't a byte or merge, or for bytes that aren't UTF-8."""
        try:
            return b"".join(self.piece[int(i)] for i in ids).decode("utf-8")
        except KeyError as e:
            raise ValueError(f"unknown token id {e.args[0]}") from None
        except UnicodeDecodeError as e:
            raise ValueError(f"token bytes are not UTF-8: {e}") from None

    def joined_pairs(self) -> set[bytes]:
        """Pairs of adjacent bytes that lie inside some token. Between any other pair no merge can reach across."""
        return {p[k : k + 2] for p in self.piece.values() for k in range(len(p) - 1)}

    def to_dict(self) -> dict:
        return {"format": FORMAT, "version": VERSION, "special_tokens": self.special_tokens, "merges": [list(m) for m in self.merges]}

    @classmethod
    def from_dict(cls, data: dict) -> BpeModel:
        if not str(data.get("format")).endswith(KIND) or data.get("version") != VERSION:
            raise ValueError(f"not a {FORMAT} model of version {VERSION}")
        return cls([tuple(m) for m in data["merges"]], data["special_tokens"])

    def save(self, path: str | Path) -> None:
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(self.to_dict(), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> BpeModel:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def train(cls, weighted: Iterable[tuple[bytes, int]], vocab_size: int, special_tokens: Sequence[str] = SPECIAL_TOKENS) -> BpeModel:
        """Greedy merges over distinct byte strings with their numbers of occurrences.

        All strings lie in one array of two bytes an id (four in a vocabulary over 65,000) with a mark around each; a
        merge looks through it, counts only what changes around its places and closes the gaps. Occurrences overlap when
        counted (``aaa`` has the pair twice) and do not when merged; ties go to the smaller pair."""
        first = BYTES + len(special_tokens)
        if vocab_size < first:
            raise ValueError(f"vocab_size must be at least {first}")
        kind = np.dtype(np.uint16 if vocab_size < 65_000 else np.uint32)
        mark = int(np.iinfo(kind).max)
        edge = np.array([mark], kind).tobytes()
        held, weights, lengths = bytearray(edge), array("q"), array("q")
        for word, times in weighted:
            if word and times:
                held += np.frombuffer(word, np.uint8).astype(kind).tobytes()
                held += edge
                weights.append(times), lengths.append(len(word) + 1)
        ids, weight = np.frombuffer(held, kind), np.frombuffer(weights, np.int64)
        ends = np.cumsum(np.frombuffer(lengths, np.int64))
        count: dict[tuple[int, int], int] = defaultdict(int)

        def add(places: np.ndarray, sign: int) -> set[tuple[int, int]]:
            """Counts of the pairs that begin at ``places`` are added or taken away."""
            a, b = ids[places].astype(np.int64), ids[places + 1].astype(np.int64)
            inside = np.nonzero((a != mark) & (b != mark))[0]
            key, w = (a[inside] << 32) | b[inside], weight[np.searchsorted(ends, places[inside])]
            order = np.argsort(key, kind="stable")
            key, w = key[order], w[order]
            new = np.nonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))[0]
            pairs = [(k >> 32, k & 0xFFFFFFFF) for k in key[new].tolist()]
            for p, n in zip(pairs, np.add.reduceat(w, new).tolist() if len(new) else ()):
                count[p] += sign * n
            return set(pairs)

        for lo in range(0, len(ids) - 1, STEP_IDS):
            add(np.arange(lo, min(lo + STEP_IDS, len(ids) - 1)), 1)
        heap = [(-c, p) for p, c in count.items()]
        heapq.heapify(heap)
        merges: list[tuple[int, int]] = []
        while first + len(merges) < vocab_size:
            while heap and -heap[0][0] != count.get(heap[0][1], 0):
                heapq.heappop(heap)
            if not heap:
                break
            a, b = pair = heapq.heappop(heap)[1]
            new = first + len(merges)
            merges.append(pair)
            there = np.concatenate([np.zeros(0, np.int64), *(lo + np.nonzero((ids[lo : min(lo + STEP_IDS, len(ids) - 1)] == a) & (ids[lo + 1 : lo + 1 + STEP_IDS] == b))[0] for lo in range(0, len(ids) - 1, STEP_IDS))])
            if a == b:
                # In a run of one id every second place is the begin of a pair.
                run = np.nonzero(np.concatenate([[True], np.diff(there) != 1]))[0]
                there = there[(np.arange(len(there)) - np.repeat(run, np.diff(np.append(run, len(there))))) % 2 == 0]
            changed = {pair} | add(_near(there, 2), -1)
            ids[there] = new
            ids = _without(ids, there + 1)
            ends = ends - np.searchsorted(there, ends)
            changed |= add(_near(there - np.arange(len(there)), 1), 1)
            for p in changed:
                if count[p] > 0:
                    heapq.heappush(heap, (-count[p], p))
                else:
                    count.pop(p, None)
        return cls(merges, special_tokens)


def _near(places: np.ndarray, after: int) -> np.ndarray:
    """Sorted ``places``, the one before each and those up to ``after`` - 1 after it, each once."""
    out = np.concatenate([places + k for k in range(-1, after)])
    out.sort()
    return out[np.concatenate([np.ones(min(1, len(out)), bool), out[1:] != out[:-1]])]


def _without(ids: np.ndarray, dead: np.ndarray) -> np.ndarray:
    """``ids`` without the places ``dead`` (sorted), moved within the same array."""
    end = 0
    bounds = np.searchsorted(dead, np.arange(0, len(ids) + STEP_IDS, STEP_IDS))
    for k, lo in enumerate(range(0, len(ids), STEP_IDS)):
        part = ids[lo : lo + STEP_IDS]
        gone = dead[bounds[k] : bounds[k + 1]] - lo
        left = np.delete(part, gone) if len(gone) else part.copy() if end < lo else part
        ids[end : end + len(left)] = left
        end += len(left)
    return ids[:end]
