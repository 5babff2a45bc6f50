"""Repeated phrases removed with Aho-Corasick automata.

In each shard the passages that recur are confirmed word by word and compiled into one automaton; the shard's pieces
are streamed through it, which locates every occurrence. Of a passage's occurrences the first in the corpus stays.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from loomgraph.llm import passages
from loomgraph.llm.text import words

#: Words of a passage, and of its anchor.
WINDOW = 20
GRAM = 6
#: Bytes of text for each shard; an automaton takes some hundred times the passages it holds.
SHARD_BYTES = 2 << 20

#: Letters that words are turned into: all code points but surrogates and zero.
_LETTERS = 0x110000 - 0x800 - 1


def _letter(number: int) -> str:
    number += 1
    return chr(number if number < 0xD800 else number + 0x800)


class Alphabet:
    """Turns words into letters, so that an automaton over text is one over words. Every word takes ``width``
    letters, one unless there are more words than letters."""

    def __init__(self, texts: list[list[bytes]]):
        self.numbers: dict[bytes, int] = {}
        for text in texts:
            for word in text:
                self.numbers.setdefault(word, len(self.numbers))
        self.width = 1 if len(self.numbers) <= _LETTERS else 2
        self.code = {
            word: _letter(i) if self.width == 1 else _letter(i // _LETTERS) + _letter(i % _LETTERS) for word, i in self.numbers.items()
        }

    def spell(self, text: list[bytes]) -> str:
        return "".join(map(self.code.__getitem__, text))


def occurrences(spelled: list[str], times: list[int], width: int, window: int, alone: list[bool] | None = None) -> tuple[list[list[tuple[int, int, int]]], int]:
    """For each text the (start, passage, windows) of every recurring passage in it, and how many passages recur.

    Passages that occur twice, with text i standing for ``times[i]`` equal ones, are confirmed by their words; one
    automaton holds them all, and every text is streamed through it. A text that shares nothing with others, as
    ``alone`` says, is one passage; any other is cut into passages of one window.
    """
    import ahocorasick

    span = window * width
    seen: Counter[str] = Counter()
    for i, (text, n) in enumerate(zip(spelled, times)):
        if alone is not None and alone[i]:
            seen[text] += n
        else:
            for j in range(0, len(text) - span + 1, width):
                seen[text[j : j + span]] += n
    automaton = ahocorasick.Automaton()
    confirmed = 0
    for passage, n in seen.items():
        if n > 1:
            automaton.add_word(passage, (confirmed, len(passage)))
            confirmed += 1
    del seen
    if not confirmed:
        return [[] for _ in spelled], 0
    automaton.make_automaton()
    found = []
    for text in spelled:
        hits = ((end + 1 - length, passage, length) for end, (passage, length) in automaton.iter(text))
        found.append([(start // width, passage, (length - span) // width + 1) for start, passage, length in hits if start % width == 0])
    return found, confirmed


def _judge(contents: list[bytes], numbers: list[int], places: list[np.ndarray], alone: list[bool]) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    # rows equal in id and text bring one place twice
    places = [np.unique(p) if len(p) > 1 else p for p in places]
    # a piece that stands once, with an anchor that no other piece has, holds nothing that recurs
    keep = [i for i, (p, only) in enumerate(zip(places, alone)) if len(p) > 1 or not only]
    texts = [contents[i].split(b" ") for i in keep]
    alphabet = Alphabet(texts)
    spelled = [alphabet.spell(t) for t in texts]
    del texts
    found, confirmed = occurrences(spelled, [len(places[i]) for i in keep], alphabet.width, WINDOW, [alone[i] for i in keep])
    best: list[tuple | None] = [None] * confirmed
    owner = [-1] * confirmed
    for i, hits in zip(keep, found):
        if hits:
            no_id, id_, hash_, start = places[i][0].tolist()
            for at, passage, _ in hits:
                own = (no_id, id_, hash_, start + at)
                if best[passage] is None or own < best[passage]:
                    best[passage], owner[passage] = own, i
    for i, hits in zip(keep, found):
        if not hits:
            continue
        gone = np.zeros(numbers[i], bool)
        for at, _, windows in hits:
            gone[at : at + windows] = True
        everywhere = passages.intervals(gone)
        # the least place of a piece keeps the passages that occur there first
        for at, passage, windows in hits:
            if owner[passage] == i:
                gone[at : at + windows] = False
        yield places[i], [passages.intervals(gone), *[everywhere] * (len(places[i]) - 1)]


def _judge_windows(contents: list[bytes], numbers: list[int], places: list[np.ndarray], alone: list[bool]) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    """Of windows that came one by one, all but the first of equal ones go."""
    for where in map(np.unique, places):
        if len(where) > 1:
            yield where[1:], [[0, 1]] * (len(where) - 1)


def _finish(text: bytes, spans: list[int]) -> tuple[int, int, str]:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    gone = passages.covered(spans, WINDOW, len(starts))
    kept = b" ".join([text[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist())])
    return len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def phrase_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a WINDOW-word passage that also starts earlier: in a document of smaller id, or
    earlier in the same one.

    Returns a row for each row: the id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).
    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged. Passages are judged on the input and do not
    cross documents. A null text has no words. Null ids come last; documents of equal id are ordered by their texts'
    hash, and rows equal in id and text are one document, whose verdict they share. An empty table gives no rows.
    Other columns are ignored.
    """
    kind = passages.Windows(True, WINDOW, GRAM, SHARD_BYTES)
    schema = "n_words bigint, n_removed bigint, kept_sha256 string"
    return passages.removed_from(docs, id_col, text_col, kind, (_judge, _judge_windows), schema, _finish)


#: The same rows in DuckDB.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, w, unnest(range(1, len(w) + 1)) as j from d),
k as (
  select doc_id, j, w[j] as word, case when j + 19 <= len(w) then array_to_string(w[j:j + 19], ' ') end as passage from x),
f as (select *, case when passage is null then false else row_number() over (partition by passage order by doc_id, j) > 1 end as later from k),
g as (select *, max(later) over (partition by doc_id order by j rows between 19 preceding and current row) as gone from f),
a as (select doc_id, count(*) as n, count(*) filter (gone) as r, string_agg(word, ' ' order by j) filter (not gone) as kept from g group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(r, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join a on d.doc_id = a.doc_id
"""
