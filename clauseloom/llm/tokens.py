"""Whole texts to token ids, a batch at a time, with each distinct word encoded once.

Both tokenizers split a text at white space, and between letters or digits and other
signs, before anything else; so a text's ids are the ids of its words in turn.  A text is
cut at single spaces and line feeds that stand between two visible characters, and, if it
has no apostrophe, where ASCII signs meet letters or digits.  A text with any other white
space beside a space, or with the mark of a special token, is encoded whole.
So is one with the one letter whose lower case is two characters.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that a cut may stand between (RE2).
_SEEN = r"!-~\p{L}\p{N}\p{P}\p{S}"
_IRREGULAR = rf"\A[ \n]|[ \n]\z|[^{_SEEN}][ \n]|[ \n][^{_SEEN}]|<\||\x00|\x{{130}}"
_SIGN, _WORD = r"[!-&(-/:-@\[-`{-~]", r"[\p{L}\p{N}]"
#: Words of Western European letters: one word for either tokenizer, stable under
#: normalisation, with a lower case that no neighbour changes.
_SIMPLE = r"\A[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+\z"
_SOME = 20_000
#: Texts taken together, and words remembered.
_TEXTS, _TABLE = 2048, 600_000


def _shown_bytes() -> np.ndarray:
    """How byte-level vocabularies write bytes: those without a visible sign of their own
    in Latin-1 take the code points from 256 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    table = np.arange(256, dtype="<u4")
    table[hidden] = 256 + np.arange(len(hidden))
    return table


_SHOWN = _shown_bytes()


def _shown(words: list[str]) -> list[str]:
    """The words, which hold no exclamation mark, as byte-level vocabularies write them."""
    codes = np.frombuffer("!".join(words).encode(), dtype=np.uint8)
    return _SHOWN[codes].tobytes().decode("utf-32-le").split("!")


@lru_cache(maxsize=2)
def word_encoder(path: str, leading: bool, words: int = _TABLE, together: int = _TEXTS) -> WordEncoder:
    """One per worker process, so that tasks after the first find most words encoded."""
    return WordEncoder(path, leading, words, together)


class WordEncoder:
    """Encodes Arrow arrays of texts, and remembers a bounded number of words.

    ``leading`` tells that the space before a word belongs to it (byte-level vocabularies);
    otherwise white space is dropped and case is folded.  ``words`` are remembered at most,
    and ``together`` texts taken at once: what a worker holds, never what comes out.
    """

    def __init__(self, path: str, leading: bool, words: int = _TABLE, together: int = _TEXTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.leading = Tokenizer.from_file(path), leading
        self.words, self.together = words, together
        self.model = self.tokenizer.model
        self._forget()

    def _lists(self, texts: list[str], simple: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each begins and ends.

        A ``simple`` text is one word for the tokenizer, so its model can be asked directly.
        """
        flat, ends = [np.zeros(0, dtype=np.uint32)], [np.zeros(1, dtype=np.int64)]
        tokenize = self.model.tokenize
        for at in range(0, len(texts), _SOME):
            some = texts[at: at + _SOME]
            direct = simple[at: at + _SOME] if simple else [False] * len(some)
            whole = iter([e.ids for e in self.tokenizer.encode_batch_fast(
                [t for t, d in zip(some, direct) if not d], add_special_tokens=False)])
            words = iter(_shown([t for t, d in zip(some, direct) if d]))
            ids = [[x.id for x in tokenize(next(words))] if d else next(whole) for d in direct]
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat.append(np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum())))
            ends.append(np.cumsum(size) + ends[-1][-1])
        return np.concatenate(flat), np.concatenate(ends)

    def _known(self, words: list[str], simple: list[bool]) -> np.ndarray:
        """Places of the words in the table, new ones encoded first."""
        if len(self.table) + len(words) > self.words:
            self._forget()
        fresh = {w: s for w, s in zip(words, simple) if w not in self.table}
        if fresh:
            flat, ends = self._lists(list(fresh), list(fresh.values()))
            self.table.update(zip(fresh, range(len(self.begin), len(self.begin) + len(fresh))))
            self.begin = np.concatenate((self.begin, ends[:-1] + len(self.flat)))
            self.size = np.concatenate((self.size, np.diff(ends)))
            self.flat = np.concatenate((self.flat, flat))
        return np.fromiter(map(self.table.__getitem__, words), dtype=np.int64, count=len(words))

    def _forget(self) -> None:
        self.table: dict[str, int] = {}
        self.flat, self.begin, self.size = (np.zeros(0, dtype=t) for t in (np.uint32, np.int64, np.int64))

    def __call__(self, texts: pa.Array):
        """The ids of each text, as arrays, in order."""
        for at in range(0, len(texts), self.together):
            yield from self._some(texts.slice(at, self.together))

    def _some(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _IRREGULAR)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        flat_odd, ends_odd = self._lists(texts.take(pa.array(whole)).to_pylist())
        place = dict(zip(whole.tolist(), range(len(whole))))
        plain = pc.if_else(odd, "", texts)
        # behind a cut at white space the space is dropped, so cuts elsewhere carry a mark
        cut = plain
        for left, right in ((_WORD, _SIGN), (_SIGN, _WORD)):
            cut = pc.replace_substring_regex(cut, f"({left})({right})", "\\1 \0\\2" if self.leading else r"\1 \2")
        plain = pc.if_else(pc.match_substring(plain, "'"), plain, cut)
        plain = pc.replace_substring(plain, "\n", " \n" if self.leading else " ")
        if not self.leading:
            plain = pc.ascii_lower(plain)  # the tokenizer would do so for every word
        lists = pc.split_pattern(plain, " ")
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        index, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
        simple = pc.match_substring_regex(words.dictionary, _SIMPLE).to_pylist()
        if self.leading:  # the first word of a text has no space before it
            first = lists.values.take(pa.array(offsets[:-1] + lists.offsets[0].as_py())).dictionary_encode()
            index = index.copy()
            index[offsets[:-1]] = first.indices.to_numpy() + len(distinct)
            distinct = [w[1:] if w[:1] == "\0" else w if w[:1] == "\n" else " " + w for w in distinct]
            distinct += first.dictionary.to_pylist()
            simple += [False] * len(first.dictionary)
        else:
            distinct = [w.lower() if s else w for w, s in zip(distinct, simple)]
        index = self._known(distinct, simple)[index]
        flat, begin, size = self.flat, self.begin, self.size
        for i in range(len(texts)):
            if i in place:
                at = place[i]
                yield flat_odd[ends_odd[at]: ends_odd[at + 1]]
                continue
            mine = index[offsets[i]: offsets[i + 1]]
            length = size[mine]
            upto = np.cumsum(length)
            total = int(upto[-1])
            yield flat[np.arange(total) + np.repeat(begin[mine] - (upto - length), length)]
