"""Token counts by a tokenizer compiled to finite-state transducers.

A word-level BPE is a function on words, and the number of tokens of every
prefix of a word can be told from a bounded piece of its past: the last token
of a prefix's encoding begins where an earlier prefix ends, and two tokens may
stand beside each other if no merge across their border comes before those
that built them.  So a state holds, for each place from which a token may
still be going on, the vocabulary's trie node reached, the last token before
it and how many tokens fewer that prefix has.  A symbol (a byte, or a byte
that ends its word) leads to the next state, and the transition is annotated
with the tokens emitted: the prefix's count less the one before it, which a
merge makes negative.  States with equal content are one state.

Transitions are compiled at first use and kept by the Python worker, in a table
of at most MAX_CELLS cells; a full table keeps the states in use and starts
again.  A text becomes a stream of symbols (normalised, cut at the borders
that the tokenizer's own pattern sets), cut into chunks that run in lockstep.
A chunk's state map is computed for one entry state, that which the symbols
just before the chunk lead to; a prefix scan composes the maps, and a chunk
whose entry state isn't its predecessor's exit state runs again from that.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from lotquery.llm.bpe import LETTER, LONG, NUMBER, OTHER, SHORT, SPACE, Merges, byte_letters
from lotquery.llm.common import map_texts, utf8

#: The cutting pattern whose borders ``word_ends`` gives.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Tokens above which a text is over the limit.
LIMIT = 2048
#: Symbols of a chunk at least, symbols before it that tell its entry state, chunks of a stream at most.
CHUNK, BEFORE, LANES = 256, 24, 4096
#: Cells of the transition table, four bytes each.
MAX_CELLS = 3 << 23


class Counter:
    """Counts the tokens that the tokenizers library makes of texts."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer
        self.definition = definition
        form = json.loads(definition)
        model, pre = form["model"], form["pre_tokenizer"]
        cuts = pre.get("pretokenizers", [pre]) if pre else []
        if (model["type"] != "BPE" or model["end_of_word_suffix"] is None or model["continuing_subword_prefix"]
                or model["dropout"] or model["ignore_merges"] or form["post_processor"]
                or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["pattern"] != {"Regex": PATTERN}
                or not cuts[0]["invert"] or cuts[0]["behavior"] != "Removed" or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]
                or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in form["added_tokens"])):
            raise ValueError("only a byte-level BPE with word ends and the known cutting pattern can be compiled")
        self.library = Tokenizer.from_str(definition)
        self.kinds = np.full(0x110000, -1, np.int8)
        self.lower = [n["type"] for n in form["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] if (
            form["normalizer"] and form["normalizer"]["type"] == "Sequence") else False
        special = sorted((t["content"] for t in form["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        vocab, end, shown = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.merges = Merges(model, [vocab[c] for c in shown] + [vocab[c + end] for c in shown])
        self._start([])

    def __reduce__(self):
        return Counter, (self.definition,)

    # --- the transducer -------------------------------------------------------

    def _start(self, states: list[tuple]) -> None:
        """An empty table that knows the word start, as state 0, and ``states``."""
        start = ((0, -1, 0),)
        self.states = [start, *(s for s in states if s != start)]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.columns = np.zeros(256, np.int32)  # of bytes; 0 is that of no symbol
        self.bytes: list[int] = []
        self.wide = 48
        self.merges.beside.clear()
        self._grow(np.zeros((0, self.wide * 2), np.int32))

    def _grow(self, old: np.ndarray) -> None:
        old = old[:len(self.states)]
        rows = max(len(self.states) + 1, min(2 * max(512, len(old), len(self.states)), MAX_CELLS // (2 * self.wide)))
        self.table = np.full((rows, 2 * self.wide), -1, np.int32)
        self.table[:len(old), :old.shape[1] // 2] = old[:, :old.shape[1] // 2]
        self.table[:len(old), self.wide:self.wide + old.shape[1] // 2] = old[:, old.shape[1] // 2:]
        self.table[:, 0] = 128 + (np.arange(len(self.table)) << 8)  # no symbol: the state stays, nothing is emitted

    def _columns_of(self, seen: np.ndarray) -> None:
        """Give every byte value in ``seen`` a column."""
        for b in seen[self.columns[seen] == 0].tolist():
            self.bytes.append(b)
            self.columns[b] = len(self.bytes)
            if len(self.bytes) + 1 == self.wide:
                old, self.wide = self.table, self.wide + 16
                self._grow(old)

    def _step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The state after ``symbol`` and the tokens emitted."""
        live, emitted, last = [], None, -1
        children, token = self.merges.children, self.merges.token
        for node, before, fewer in state:
            child = children[node].get(symbol)
            if child is None:
                continue
            t = token[child]
            if t >= 0 and emitted is None and (before < 0 or self.merges.stand_beside(before, t)):
                emitted, last = 1 - fewer, t
            if children[child]:
                live.append((child, before, fewer))
        return (*((c, b, f + emitted) for c, b, f in live), (0, last, 0)), emitted

    def _learn(self, cells: np.ndarray) -> None:
        for cell in cells.tolist():
            state, column = divmod(cell, 2 * self.wide)
            ends = column >= self.wide
            symbol = self.bytes[column - ends * self.wide - 1] + 256 * ends
            after, emitted = self._step(self.states[state], symbol)
            to = 0 if ends else self.number.setdefault(after, len(self.states))
            if to == len(self.states):
                self.states.append(after)
            if to >= len(self.table):
                self._grow(self.table)
            self.table[state, column] = (to << 8) + emitted + 128

    def _run(self, lanes: np.ndarray, state: np.ndarray, held: np.ndarray, out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All lanes (a column each) from their states; tokens emitted go to
        ``out``.  Returns the states after it, and ``held`` in today's numbers."""
        for t in range(len(lanes)):
            cell = state * (2 * self.wide) + lanes[t]
            found = self.table.ravel()[cell]
            if (found < 0).any():
                missing = np.unique(cell[found < 0])
                if (len(self.states) + len(missing)) * 2 * self.wide > MAX_CELLS:
                    used, number = np.unique(np.concatenate([state, held]), return_inverse=True)
                    kept, bytes_ = [self.states[s] for s in used], self.bytes
                    self._start(kept)
                    again = np.array([self.number[k] for k in kept], np.int64)[number]
                    state, held = again[:len(state)], again[len(state):]
                    self._columns_of(np.array(bytes_, np.int64))  # in the same order, so lanes stay as they are
                    cell = state * (2 * self.wide) + lanes[t]
                    missing = np.unique(cell[self.table.ravel()[cell] < 0])
                self._learn(missing)
                found = self.table.ravel()[state * (2 * self.wide) + lanes[t]]
            state = (found >> 8).astype(np.int64)
            if out is not None:
                out[t] = (found & 255) - 128
        return state, held

    def emitted(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens emitted at each symbol of a stream of bytes, ``ends`` marking
        those that end a word; their sum over whole words is the words' count."""
        if not len(data):
            return np.zeros(0, np.int16)
        self._columns_of(np.unique(data))
        chunk = max(CHUNK, -(-len(data) // LANES))
        n = -(-len(data) // chunk)
        stream = np.zeros(BEFORE + n * chunk, np.int32)
        stream[BEFORE:BEFORE + len(data)] = self.columns[data] + self.wide * ends
        lanes = np.ascontiguousarray(stream[BEFORE:].reshape(n, chunk).T)
        ahead = stream[np.arange(BEFORE)[:, None] + np.arange(n) * chunk]
        out = np.empty((chunk, n), np.int16)
        none = np.zeros(0, np.int64)
        entry, _ = self._run(ahead, np.zeros(n, np.int64), none, None)
        leave, entry = self._run(lanes, entry, entry, out)
        while True:  # the scan: maps compose where one's exit state is the next one's entry state
            wrong = 1 + np.flatnonzero(leave[:-1] != entry[1:])
            if not len(wrong):
                return out.T.reshape(-1)[:len(data)]
            entry[wrong] = leave[wrong - 1]
            again = np.empty((chunk, len(wrong)), np.int16)
            after, held = self._run(np.ascontiguousarray(lanes[:, wrong]), entry[wrong], np.concatenate([entry, leave]), again)
            entry, leave = held[:n], held[n:]
            out[:, wrong], leave[wrong] = again, after

    # --- texts ----------------------------------------------------------------

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """Each character's kind, as the library's own pattern takes it."""
        kinds = self.kinds[points]
        if (kinds < 0).any():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kinds < 0]).tolist():
                c = chr(p)
                if not cut(c):
                    kind = SPACE
                elif len(cut("a" + c)) == 1:
                    kind = LETTER
                else:
                    kind = NUMBER if len(cut(c + c)) == 2 else OTHER
                self.kinds[p] = kind
            kinds = self.kinds[points]
        return kinds

    def word_ends(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which characters belong to a word, and which end one."""
        kinds = self._kinds(points)
        inside = kinds != SPACE
        begins = inside & ((kinds == NUMBER) | (kinds != np.concatenate([[SPACE], kinds[:-1]])))
        if len(quotes := np.flatnonzero(begins & (points == ord("'")))):
            ahead = np.concatenate([points, [0, 0]])
            one, two = ahead[quotes + 1], ahead[quotes + 2]
            long = np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in LONG])
            for where, n in ((quotes[np.isin(one, [ord(x) for x in SHORT])], 1), (quotes[long], 2)):
                begins[where + 1] = False
                after = where + 1 + n
                after = after[after < len(points)]
                begins[after] = inside[after]
        return inside, inside & np.concatenate([begins[1:] | ~inside[1:], [True]])

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text."""
        counts = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, raw in enumerate(texts):
            text = raw.decode()
            pieces = [text]
            if self.special and b"<" in raw or self.special and not raw.isascii():
                pieces = self.special.split(text)
                counts[i] += len(pieces) - 1
            for piece in pieces:
                if piece:
                    normal = self.library.normalizer
                    parts.append(piece.lower() if self.lower and piece.isascii() else normal.normalize_str(piece) if normal else piece)
                    owner.append(i)
        if not parts:
            return counts
        whole = " ".join(parts)  # white space is in no word, and ends one
        raw = whole.encode()
        ends_at = np.cumsum([len(p) + 1 for p in parts])
        if len(raw) == len(whole):
            data = np.frombuffer(raw, np.uint8)
            inside, ends = self.word_ends(data.astype(np.int64))
        else:
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
            inside, ends = self.word_ends(points)
            size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            last = np.cumsum(size) - 1
            data = np.frombuffer(raw, np.uint8)
            ends_at = np.concatenate([[0], last + 1])[np.minimum(ends_at, len(points))]
            inside = np.repeat(inside, size)
            at_end = np.zeros(len(data), bool)
            at_end[last[ends]] = True
            ends = at_end
        sums = np.concatenate([[0], np.cumsum(self.emitted(data[inside], ends[inside]), dtype=np.int64)])
        upto = sums[np.concatenate([[0], np.cumsum(inside)])[np.minimum(ends_at, len(data))]]
        np.add.at(counts, owner, np.diff(upto, prepend=0))
        return counts


_COMPILED: dict[int, Counter] = {}


def count_tokens(df: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of
    each row's whole text, as the tokenizers library counts them without
    special tokens added; a special token's string inside a text is one token.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated
    rows; an empty table gives an empty one; other columns aren't read.
    ``tokenizer`` is a file that the driver reads, of the kind that ``Counter`` takes."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    Counter(definition)  # an unfit file fails here
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(definition))
    key = hash(definition)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle
        if key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[key] = Counter(pickle.loads(sent.value))
        counter = _COMPILED[key]
        for batch in batches:
            texts = utf8(batch)
            tokens = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return map_texts(df.select("doc_id", "text"), each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
