"""BPE encoding and decoding in batched numpy merge rounds.

A tokenizer file gives the normaliser (NFC, white space to a space, lower case), the split pattern,
the byte alphabet and the merges. Words that a task has not met yet are merged together, all at
once: their symbols lie in one flat array, and each round finds the rank of every adjacent pair by
binary search over the sorted pair keys and joins each word's lowest-ranked pair, leftmost first.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import shipped, table

#: Stretches whose ids a task remembers; beyond, it forgets those of the batch at hand. Longer ones
#: than LONGEST characters, as text without white space has, are never remembered.
CACHED, LONGEST = 300_000, 64
VOCABULARY = "word_bpe_49k.json"


# Letters and numbers that the installed regex tables know but the library's do not, and
# capitals that the library lower-cases but this Python does not, each with what it is moved by.
NEWER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24"
    "\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
NEWER_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
LATE_CAPITALS = {0x1C89: 1, 0xA7CB: 0x264 - 0xA7CB, 0xA7CC: 1, 0xA7CE: 1, 0xA7D2: 1, 0xA7D4: 1, 0xA7DA: 1, 0xA7DC: 0x19B - 0xA7DC}
LATE_CAPITALS |= {c: 0x20 for c in range(0x10D50, 0x10D66)} | {c: 0x1B for c in range(0x16EA0, 0x16EB9)}
# Combining marks that the library does not know as such (and one half of a newer pair):
# nothing is reordered or joined across them.
PLAIN_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070"
    "\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47"
    "\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f"
    "\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
_LATE_LOWER = {c: c + by for c, by in LATE_CAPITALS.items()}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"]
        self.tokens: dict[int, str] = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{NEWER_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEWER_NUMBERS}]]")
        self.words = regex.compile(pattern, regex.V1)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        alphabet = byte_alphabet()
        self.byte_ids = np.array([vocab.get(c, -1) for c in alphabet], np.int64)
        self.last_ids = np.array([vocab.get(c + self.suffix, -1) for c in alphabet], np.int64)
        self.bytes_of = {c: b for b, c in enumerate(alphabet)}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._forget()

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        if not words:
            return []
        data = [w.encode() for w in words]
        lengths = np.array([len(d) for d in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        owner = np.repeat(np.arange(len(words)), lengths)
        symbols = self.byte_ids[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends[lengths > 0]] = self.last_ids[flat[ends[lengths > 0]]]
        symbols, owner = symbols[symbols >= 0], owner[symbols >= 0]  # no unknown token: the model skips what it lacks
        done_ids, done_owner = [], []
        none = np.int64(len(self.ranks))
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(owner)))
            per_symbol = np.repeat(best, size)
            active = per_symbol < none
            done_ids.append(symbols[~active])
            done_owner.append(owner[~active])
            symbols, owner, rank, per_symbol = symbols[active], owner[active], rank[active], per_symbol[active]
            if not len(symbols):
                break
            hit = rank == per_symbol
            # of hits side by side, as in a run of one symbol, every second one counts
            start = hit & ~np.append(False, hit[:-1])
            begun = np.maximum.accumulate(np.where(start, np.arange(len(hit)), -1))
            hit &= (np.arange(len(hit)) - begun) % 2 == 0
            symbols = np.where(hit, self.merged[np.minimum(per_symbol, none - 1)], symbols)
            stay = ~np.append(False, hit[:-1])
            symbols, owner = symbols[stay], owner[stay]
        ids, owners = np.concatenate(done_ids or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owners, kind="stable")  # a word ends in one round, whole and in order
        return np.split(ids[order], np.searchsorted(owners[order], np.arange(1, len(words))))

    def _learn(self, chunks: set[str]) -> None:
        """Remember the ids and the tokens of stretches without white space, which no word crosses."""
        batch = list(chunks)
        words = [self.words.findall(c) for c in batch]
        distinct = list({w for c in words for w in c})
        ids_of = dict(zip(distinct, (x.tolist() for x in self.merge(distinct)), strict=True))
        for chunk, own in zip(batch, words, strict=True):
            ids = [i for w in own for i in ids_of[w]]
            self.ids_of[chunk] = " ".join(map(str, ids))
            # without a decoder the tokens are joined by spaces, as they are
            self.text_of_chunk[chunk] = " ".join([self.tokens[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """The stretches without white space, after normalising, with special tokens on their own."""
        if "<|" not in text:
            return self._chunks(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self._chunks(text[at : m.start()]), _MARK + m.group()]
            at = m.end()
        return [*out, *self._chunks(text[at:])]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if not text.isascii():
            text = "".join(unicodedata.normalize("NFC", x) for x in _PLAIN.split(text)).replace("Σ", "σ")  # lower-cased by character: no final sigma
            if _LATE.search(text):
                text = text.translate(_LATE_LOWER)
        if _ODD_SPACE.search(text):  # str.split() also splits at these
            return [c for c in _SPACE.split(text.lower()) if c]
        return text.lower().split()

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text: its ids joined by a space, the decoded text, and how many ids."""
        parts = [self.split(t) for t in texts]
        new = set().union(*parts).difference(self.ids_of)
        self._learn(new)
        ids_of, text_of, out = self.ids_of.__getitem__, self.text_of_chunk.__getitem__, []
        for chunks in parts:
            ids = " ".join(map(ids_of, chunks))
            out.append((ids, " ".join(map(text_of, chunks)), ids.count(" ") + 1 if ids else 0))
        for chunk in [c for c in new if len(c) > LONGEST]:
            del self.ids_of[chunk], self.text_of_chunk[chunk]
        new = [c for c in new if len(c) <= LONGEST]
        if len(self.ids_of) > CACHED:  # the first ones met are mostly the frequent ones; rare ones are merged again
            for chunk in new:
                del self.ids_of[chunk], self.text_of_chunk[chunk]
        return out

    def _forget(self) -> None:
        self.ids_of = {_MARK + t: str(i) for t, i in self.special.items()}
        self.text_of_chunk = {_MARK + t: t for t in self.special}

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode_batch([text or ""])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces; unknown ids are skipped. Special tokens stay."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def text_of(self, ids: list[int]) -> str:
        """The words that the ids spell, each followed by a space, as the word ends say."""
        spelt = "".join(self.tokens[i] for i in ids if i in self.tokens and i not in self.special.values())
        data = "".join(spelt).replace(self.suffix, " ")
        return bytes(self.bytes_of.get(c, 32) for c in data).decode(errors="replace")


_SPACE, _ODD_SPACE = regex.compile(r"\s+"), regex.compile("[\x1c-\x1f]")
_LATE = regex.compile("[" + "".join(map(chr, LATE_CAPITALS)) + "]")
_PLAIN = regex.compile(f"([{PLAIN_MARKS}])")
_MARK = " "  # no stretch without white space holds one
_loaded: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    """Loaded once a Python worker."""
    if path not in _loaded:
        if not os.path.exists(path):  # another machine's place for the same public file
            import public_tokenizers

            path = public_tokenizers.path(os.path.basename(path))
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def bpe(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids for each row of docs.

    Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated
    rows. Columns other than doc_id and text are ignored. No shuffle; a task holds one batch and a
    bounded memory of words.
    """

    def rows(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts, doc = batch.column("text").to_pylist(), batch.column("doc_id")
            at = 0
            while at < len(texts):  # at most about 4 MB of text at a time
                stop, size = at, 0
                while stop < len(texts) and (size < 4 << 20 or stop == at):
                    size += len(texts[stop] or "")
                    stop += 1
                done = bpe.encode_batch([t or "" for t in texts[at:stop]])
                own = [doc.slice(at, stop - at), pa.array([n for _, _, n in done], pa.int64()), pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _, _ in done]), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d, _ in done])]
                if with_ids:
                    arrays = [np.array(i.split(), np.int32) for i, _, _ in done]
                    own.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate(arrays)))
                yield pa.record_batch(own, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(own)])
                at = stop

    kind = dict(docs.dtypes)["doc_id"]
    return shipped(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op2_bpe(spark, sf_dir):
    """Every document's ids, as their number and digest, and the digest of what they decode to."""
    import public_tokenizers

    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)
