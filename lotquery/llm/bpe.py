"""Byte-pair vocabularies: as automata over symbols (bytes), and merged directly.

In ``Merges``, the tokens of a text's prefix are known from the last of them alone: it begins
where a shorter prefix ends.  Two tokens may stand beside each other if no merge
across their border comes before those that built them, and just one token
fits at the end of each prefix.  So a state needs, for each place from which a
token may still be going on, the vocabulary's trie node reached and the last
token before it.
"""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np

from lotquery.llm.common import scramble

#: Bytes of a word that is merged here; longer ones go to the library.
LONGEST = 64
#: Words remembered by a worker, about.
KNOWN = 300_000
SPACE, LETTER, NUMBER, OTHER = range(4)
#: What a quote mark and these letters are by themselves.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes for themselves, the others by the letters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shown, other = [], 0
    for b in range(256):
        shown.append(chr(b if b in plain else 256 + other))
        other += b not in plain
    return shown


class Merges:
    """A vocabulary's tokens in a trie, and which of them may stand side by side.
    ``first``: the token of each symbol by itself."""

    def __init__(self, model: dict, first: list[int]) -> None:
        vocab = model["vocab"]
        n = max(vocab.values()) + 1
        self.left, self.right, made = [-1] * n, [-1] * n, [0] * n
        self.merges: dict[int, dict[int, int]] = defaultdict(dict)
        for rank, pair in enumerate(model["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            t = vocab[a + b]
            if made[t]:
                raise ValueError("two merges make the same token")
            self.left[t], self.right[t], made[t] = vocab[a], vocab[b], rank
            self.merges[vocab[a]][vocab[b]] = rank
        self.made = made
        symbol = {t: s for s, t in enumerate(first)}
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        self.symbols = np.zeros(n, np.int64)  # of each token
        spelt: dict[int, tuple[int, ...]] = {}
        for t in sorted(range(n), key=made.__getitem__):
            if made[t]:
                spelt[t] = spelt[self.left[t]] + spelt[self.right[t]]
            elif t in symbol:
                spelt[t] = (symbol[t],)
            else:
                continue  # added tokens
            node = 0
            self.symbols[t] = len(spelt[t])
            for s in spelt[t]:
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][s]
            self.token[node] = t
        self.right_edges: dict[int, list] = {}
        self.left_edges: dict[int, list] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def stand_beside(self, a: int, b: int) -> bool:
        """True if the encoding of the two tokens' text is just these two: no
        merge of a part at the end of ``a`` with one at the start of ``b``
        comes while both parts are there.  Of equal merges the left one is first."""
        known = self.beside.get((a, b))
        if known is not None:
            return known
        ends = self.right_edges.get(a)
        if ends is None:
            ends, part, until = [], a, 1 << 60
            while part >= 0:
                if part in self.merges:
                    ends.append((self.merges[part], until))
                part, until = self.right[part], self.made[part]
            self.right_edges[a] = ends
        starts = self.left_edges.get(b)
        if starts is None:
            starts, part, until = [], b, 1 << 60
            while part >= 0:
                starts.append((part, until))
                part, until = self.left[part], self.made[part]
            self.left_edges[b] = starts
        known = True
        for partners, until in ends:
            for part, also in starts:
                rank = partners.get(part)
                if rank is not None and rank < until and rank <= also:
                    known = False
        self.beside[(a, b)] = known
        return known


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``size`` numbers, for all of them in a row."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Pairs:
    """Rank of the merge of two tokens, for arrays of pairs: a hash table, and a
    small second one without collisions for the pairs that collide in the first.
    An entry is left token, right token and rank, of WIDTH bits each."""

    BITS, MORE, WIDTH = 20, 18, 21
    NONE = np.int32(1 << 24)

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        codes = left.astype(np.uint64) << np.uint64(self.WIDTH) | right.astype(np.uint64)
        ranks = np.arange(len(codes), dtype=np.uint64)
        self.tables = []
        dice = np.random.default_rng(3)
        for bits in (self.BITS, self.MORE):
            for tries in range(1, 10_000):
                factor = np.uint64(dice.integers(1 << 62) * 2 + 1)
                slot = codes * factor >> np.uint64(64 - bits)
                _, first = np.unique(slot, return_index=True)
                if len(self.tables) == 0 or len(first) == len(codes):
                    break
                bits += tries % 50 == 0
            held = np.full(1 << bits, np.uint64(2**64 - 1))
            held[slot[first]] = codes[first] << np.uint64(self.WIDTH) | ranks[first]
            self.tables.append((factor, np.uint64(64 - bits), held))
            rest = np.ones(len(codes), bool)
            rest[first] = False
            codes, ranks = codes[rest], ranks[rest]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        width = np.uint64(self.WIDTH)
        codes = left.astype(np.uint64) << width | right.astype(np.uint64)
        out = np.full(len(codes), self.NONE)
        for factor, shift, held in self.tables:
            entry = held[(codes * factor >> shift).astype(np.int64)]
            hit = np.flatnonzero(entry >> width == codes)
            out[hit] = entry[hit] & np.uint64((1 << self.WIDTH) - 1)
        return out


class Grown:
    """An array that grows at its end."""

    def __init__(self, values: np.ndarray) -> None:
        self.held, self.n = values, len(values)

    def __getitem__(self, at):
        return self.held[at]

    @property
    def values(self) -> np.ndarray:
        return self.held[:self.n]

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate([self.values, np.empty(max(n, 1_024), self.held.dtype)])
        self.held[self.n:n] = values
        self.n = n


class Words:
    """The words of a batch, eight bytes at a time."""

    MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.data, self.start, self.size = data, start, size
        self.eights = np.concatenate([data, np.zeros(16 - len(data) % 8, np.uint8)]).view("<u8")
        self.head = self.part(slice(None), 0)
        #: Which words go on after 8, 16, ... bytes (those up to LONGEST bytes), and their next eight.
        self.later = []
        on = np.flatnonzero((size > 8) & (size <= LONGEST))
        while len(on):
            self.later.append((on, self.part(on, len(self.later) + 1)))
            on = on[size[on] > 8 * len(self.later) + 8]
        hashes = self.head * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        for on, part in self.later:
            own = hashes[on]
            hashes[on] = (own ^ own >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) + part
        self.hashes = scramble(hashes)

    def part(self, words, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of words, zeros after their ends."""
        at = self.start[words] + 8 * k
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        both = self.eights[place] >> shift | self.eights[place + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return both & self.MASKS[np.minimum(self.size[words] - 8 * k, 8)]

    def same(self, words: np.ndarray, others: np.ndarray) -> bool:
        """True if each word has the bytes of the other beside it."""
        if (self.size[words] != self.size[others]).any() or (self.head[words] != self.head[others]).any():
            return False
        k = 1
        while len(on := np.flatnonzero(self.size[words] > 8 * k)):
            words, others = words[on], others[on]
            if (self.part(words, k) != self.part(others, k)).any():
                return False
            k += 1
        return True


class Known:
    """Words of earlier batches with their tokens, in a hash table with two slots
    for a word, where a later word takes an earlier one's place; a hit counts only
    if all bytes agree.  At most about KNOWN words, the last used.  Entry 0 is no word."""

    BITS = 20

    def __init__(self) -> None:
        self.slots = np.zeros(1 << self.BITS, np.int32)
        self.columns = [Grown(np.zeros(1, kind)) for kind in (np.uint64, np.uint64, np.int64, np.int32, np.int64, np.int32, np.int32)]
        # hash, first eight bytes, place of the others in ``more``, size; place in ``tokens`` and number of them, batch of the last use
        self._hashes, self.head, self.rest, self.size, self.begin, self.count, self.used = self.columns
        self.more, self.tokens, self.batch = Grown(np.zeros(0, np.uint64)), Grown(np.zeros(0, np.int32)), 0

    @property
    def hashes(self) -> np.ndarray:
        return self._hashes.values

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.BITS)
        return (hashes >> shift).astype(np.int64), (hashes << np.uint64(self.BITS) >> shift).astype(np.int64)

    def find(self, words: Words) -> np.ndarray:
        """The entries of words, 0 for those not known."""
        one, two = self._places(words.hashes)
        found = self.slots[one]
        other = np.flatnonzero((self.size[found] != words.size) | (self.head[found] != words.head))
        mine = self.slots[two[other]]
        wrong = (self.size[mine] != words.size[other]) | (self.head[mine] != words.head[other])
        mine[wrong] = 0
        found[other] = mine
        for k, (on, part) in enumerate(words.later):
            known = np.flatnonzero(found[on])
            wrong = self.more[self.rest[found[on[known]]] + k] != part[known]
            found[on[known[wrong]]] = 0
        found[words.size > LONGEST] = 0
        return found

    def _enter(self, entries: np.ndarray) -> None:
        one, two = self._places(self._hashes[entries])
        free = self.slots[one] == 0
        self.slots[one[free]] = entries[free]
        late = self.slots[one] != entries
        self.slots[two[late]] = entries[late]

    def add(self, words: Words, which: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries for some words of at most LONGEST bytes."""
        size = words.size[which]
        more = size - 1 >> 3
        start = np.cumsum(more) - more
        parts = np.zeros(int(more.sum()), np.uint64)
        for k in range(1, int(size.max()) + 7 >> 3):
            on = np.flatnonzero(more >= k)
            parts[start[on] + k - 1] = words.part(which[on], k)
        entries = self._put([words.hashes[which], words.head[which], start + self.more.n, size], tokens, counts)
        self.more.add(parts)
        self._enter(entries)
        return entries

    def add_unnamed(self, tokens: np.ndarray) -> int:
        """An entry that is not found again."""
        one = np.zeros(1, np.int64)
        return int(self._put([one, one, one, one], tokens, one + len(tokens))[0])

    def _put(self, values: list[np.ndarray], tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = self._hashes.n
        for column, own in zip(self.columns, [*values, np.cumsum(counts) - counts + self.tokens.n, counts, np.full(len(counts), self.batch)], strict=True):
            column.add(own)
        self.tokens.add(tokens)
        return np.arange(n, self._hashes.n, dtype=np.int32)

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of entries, one behind the other, and their numbers."""
        counts = self.count[entries]
        self.used.held[entries] = self.batch
        return self.tokens[_spread(self.begin[entries], counts)], counts

    def forget(self) -> None:
        """End a batch; keep the words last used if there are too many."""
        self.batch += 1
        if self._hashes.n <= KNOWN and self.tokens.n <= 8 * max(KNOWN, 1 << 16):
            return
        live = self.slots[self.slots > 0]
        keep = np.sort(live[np.argsort(-self.used[live], kind="stable")[:KNOWN // 2]])
        more, counts, rest = self.size[keep] - 1 >> 3, self.count[keep], self.rest[keep]
        self.more = Grown(self.more[_spread(rest, more)])
        self.tokens = Grown(self.tokens[_spread(self.begin[keep], counts)])
        keep = np.concatenate([[0], keep])
        self.columns = [Grown(column[keep]) for column in self.columns]
        self._hashes, self.head, self.rest, self.size, self.begin, self.count, self.used = self.columns
        self.rest.held[1:] = np.cumsum(more) - more
        self.begin.held[1:] = np.cumsum(counts, dtype=np.int64) - counts
        self.slots[:] = 0
        self._enter(np.arange(1, len(keep), dtype=np.int32))


class Tokens:
    """Token ids of texts by a byte-level BPE that cuts texts into words,
    numbers, marks and white space, as ``begins`` has it.  The distinct words of a
    batch are merged side by side, in rounds: in each word the first place of its
    lowest-ranked pair.  Words above LONGEST bytes go to the library."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer
        form = json.loads(definition)
        model, pre = form["model"], form["pre_tokenizer"]
        self.library = Tokenizer.from_str(definition)
        self.special = [t["content"] for t in form["added_tokens"]]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.fits = bool(model["type"] == "BPE" and not model["end_of_word_suffix"] and not model["continuing_subword_prefix"]
                         and not model["dropout"] and not model["ignore_merges"] and not form["normalizer"] and not form["post_processor"]
                         and pre and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
                         and max(self.size, *model["vocab"].values()) < (1 << Pairs.WIDTH) - 1)
        self.kinds = np.full(0x110000, -1, np.int8)
        if self.fits:
            vocab = model["vocab"]
            pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
            self.letters = byte_letters()
            self.first = np.array([vocab[c] for c in self.letters], np.int32)
            self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
            self.pairs = Pairs(*(np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1)))
            self.known = Known()
            self.of_bytes = self.pairs.rank(np.repeat(self.first, 256), np.tile(self.first, 256))
            self.ascii = self._kinds(np.arange(128)).tobytes() + bytes(128)

    def merged(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words whose bytes lie one behind the other, and how many
        each word has.  Best with the longest words first, as they take the most rounds.

        A symbol's key is the rank of its pair with the next symbol, then its place
        in the word (of 64).  A symbol without pairs lies between words."""
        if not len(sizes):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        none = int(self.pairs.NONE) - 1 << 6  # a key from here on is no pair
        words = len(sizes)
        first = np.cumsum(sizes + 1) - sizes  # place 0 lies before all words
        places = len(data) + words + 1
        there = np.ones(places, bool)
        there[0] = there[first + sizes] = False
        symbols = np.full(places, (1 << Pairs.WIDTH) - 1, np.int32)
        symbols[there] = self.first[data]
        within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rank = np.full(len(data), self.pairs.NONE)
        rank[:-1] = self.of_bytes[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank[np.cumsum(sizes) - 1] = self.pairs.NONE  # a word's last symbol
        key = np.full(places, self.pairs.NONE << 6, np.int32)
        key[there] = (rank << 6) + within
        after, before = np.arange(1, places + 1), np.arange(-1, places - 1)
        start, end = first, int(places)
        while True:
            least = np.minimum.reduceat(key[:end], start)
            on = np.flatnonzero(least < none)
            if not len(on):
                break
            if len(on) < len(start):
                start, least = start[on], least[on]
                end = int(start[-1]) + int(sizes[np.searchsorted(first, start[-1])]) + 1
            within = least & 63
            at = start + within
            gone = after[at]
            behind, ahead = before[at], after[gone]
            made = self.made[least >> 6]
            symbols[at], after[at], before[ahead] = made, ahead, at
            there[gone], key[gone] = False, none
            key[at] = (self.pairs.rank(made, symbols[ahead]) << 6) + within
            key[behind] = np.minimum((self.pairs.rank(symbols[behind], made) << 6) + (behind - start), none + 63)
        return symbols[there], np.add.reduceat(there, first, dtype=np.int64)

    def _entries(self, words: Words) -> np.ndarray:
        """The entries of a batch's words in ``known``, new ones for those not known yet."""
        found = self.known.find(words)
        fresh = np.flatnonzero((found == 0) & (words.size <= LONGEST))
        if len(fresh):
            order = fresh[np.argsort(words.hashes[fresh])]  # of equal words any one stands for all
            heads = np.concatenate([[True], np.diff(words.hashes[order]) != 0])
            one, which = order[heads], np.cumsum(heads) - 1
            if not words.same(order, one[which]):  # two words with one hash: all words by themselves
                one, which = order, np.arange(len(order))
            long_first = np.argsort(-words.size[one], kind="stable")
            one = one[long_first]
            tokens, counts = self.merged(words.data[_spread(words.start[one], words.size[one])], words.size[one])
            entries = np.empty(len(one), np.int32)
            entries[long_first] = self.known.add(words, one, tokens, counts)
            found[order] = entries[which]
        own: dict[bytes, int] = {}
        for k in np.flatnonzero(words.size > LONGEST).tolist():
            word = words.data[words.start[k]:words.start[k] + words.size[k]].tobytes()
            if word not in own:
                text = "".join(self.letters[b] for b in word)
                own[word] = self.known.add_unnamed(np.array([t.id for t in self.library.model.tokenize(text)], np.int32))
            found[k] = own[word]
        return found

    # --- texts ------------------------------------------------------------------

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """Each character's kind, as the library's own pattern takes it."""
        kinds = self.kinds[points]
        if (kinds < 0).any():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kinds < 0]).tolist():
                pairs = (("a", LETTER), ("1", NUMBER), ("!", OTHER))
                self.kinds[p] = next((kind for c, kind in pairs if len(cut(c + chr(p))) == 1), SPACE)
            kinds = self.kinds[points]
        return kinds

    def begins(self, points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters begin a word; ``first`` marks those that begin a text.
        A blank before a word belongs to it; other white space is a word of its own,
        without the last character of a run that something follows."""
        space = kinds == SPACE
        tail = np.zeros(len(first), bool)  # white space right before something else
        tail[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        begins = first | tail
        begins[1:] |= kinds[1:] != kinds[:-1]
        begins[1:] &= ~(tail & (points == 32))[:-1]  # has its blank
        quotes = np.flatnonzero(begins & (points == ord("'")))
        if len(quotes):
            last = len(points) - 1
            ended = quotes == last
            one, two = points[np.minimum(quotes + 1, last)], points[np.minimum(quotes + 2, last)]
            ended |= first[np.minimum(quotes + 1, last)]
            one[ended] = 0
            two[ended | (quotes + 2 > last) | first[np.minimum(quotes + 2, last)]] = 0
            long = np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in LONG])
            for where, n in ((quotes[np.isin(one, [ord(x) for x in SHORT])], 1), (quotes[long], 2)):
                begins[where + 1] = False
                after = where + 1 + n
                begins[after[after < len(points)]] = True
        return begins

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8).  Texts that hold a special token's string
        go to the library whole, as all do if the vocabulary is of another kind."""
        joined = b"".join(texts)
        special = [s.encode() for s in self.special if s.encode() in joined]
        whole = [not self.fits or any(s in t for s in special) for t in texts]
        out = [np.array(self.library.encode(t.decode(), add_special_tokens=False).ids, np.uint32) if w else np.zeros(0, np.uint32)
               for t, w in zip(texts, whole)]
        mine = [i for i, t in enumerate(texts) if t and not whole[i]]
        if not mine:
            return out
        if len(mine) < len(texts):
            joined = b"".join(texts[i] for i in mine)
        data = np.frombuffer(joined, np.uint8)
        size = np.array([len(texts[i]) for i in mine])
        start = np.cumsum(size) - size
        first = np.zeros(len(data), bool)
        first[start] = True
        if joined.isascii():
            begins = self.begins(data, np.frombuffer(joined.translate(self.ascii), np.int8), first)
        else:
            points = np.frombuffer("".join([texts[i].decode() for i in mine]).encode("utf-32-le"), np.uint32)
            lead = np.flatnonzero((data & 0xC0) != 0x80)  # each character's first byte
            begins = np.zeros(len(data), bool)
            begins[lead] = self.begins(points, self._kinds(points), first[lead])
        at = np.flatnonzero(begins)
        entries = self._entries(Words(data, at, np.diff(at, append=len(data))))
        tokens, counts = self.known.take(entries)
        self.known.forget()
        ids = tokens.astype(np.uint32)
        upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(at, np.append(start, len(data)))]
        for k, i in enumerate(mine):
            out[i] = ids[upto[k]:upto[k + 1]]
        return out
