"""Tokenizers and the token filter pipeline.

A filter maps a token to a token, or to None (discard). Filters are made by factories from the index
parameters; a pipeline stops at the first discard, and an empty token is discarded. Pipelines are plain
Python functions: ``millstone.operators.analysis`` runs them once for each distinct token of a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from millstone.errors import ExistsError, InvalidError
from millstone.functions.stemmer import stemmer

Filter = Callable[[str], "str | None"]
Factory = Callable[[Mapping], Filter]

SIMPLE_WORD = r"[\p{L}\p{N}_]+"

_LATIN = str.maketrans(
    {
        "ø": "o", "Ø": "O", "ð": "d", "Ð": "D", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "œ": "oe", "Œ": "OE",
        "þ": "th", "Þ": "TH", "ı": "i", "ŋ": "n", "Ŋ": "N", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ĸ": "q", "ŀ": "l", "Ŀ": "L", "ſ": "s", "ƒ": "f",
        "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...",
    }
)
_IGNORED = {0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}


def nfkc_casefold(s: str) -> str:
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold())
    return "".join(c for c in s if ord(c) not in _IGNORED)


def strip_diacritics(s: str) -> str:
    if s.isascii():
        return s
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFKC", s.translate(_LATIN))


def normalize(s: str) -> str:
    return strip_diacritics(nfkc_casefold(s))


class Registry:
    """Filters by name: the built-in ones and the user's. ``stopwords`` are lists by language that replace the built-in ones."""

    def __init__(self, stopwords: Mapping[str, frozenset[str]] | None = None):
        lists = STOPWORDS | dict(stopwords or {})

        def drop(params: Mapping) -> Filter:
            words = lists.get(params.get("lang", "en"), frozenset())
            return lambda s: None if s in words else s

        self._factories: dict[str, Factory] = {"normalizer": lambda params: normalize, "stopwords": drop, "stemmer": lambda params: stemmer(params.get("lang", "en"))}
        self._destroy: dict[str, Callable[[object], None]] = {}

    def register(self, name: str, filter: Callable, create: Callable[[Mapping], object] | None = None, destroy: Callable[[object], None] | None = None) -> None:
        """``filter(context, token)`` returns the new token, or None to discard; create(params) makes the context."""
        if name in self._factories:
            raise ExistsError(f"filter '{name}' is already registered")
        if not callable(filter):
            raise InvalidError(f"filter '{name}' has no filter function")
        self._factories[name] = lambda params: _User(filter, create(params) if create else None)
        if destroy:
            self._destroy[name] = destroy

    def pipeline(self, names: list[str], params: Mapping) -> Pipeline:
        for name in names:
            if name not in self._factories:
                raise InvalidError(f"filter '{name}' not found")
        made = [(n, self._factories[n](params)) for n in names]
        return Pipeline([f for _, f in made], [(self._destroy[n], f) for n, f in made if n in self._destroy])


class _User:
    """A user's filter with its context."""

    def __init__(self, filter: Callable, context: object):
        self.filter, self.context = filter, context

    def __call__(self, token: str) -> str | None:
        return self.filter(self.context, token)


class Pipeline:
    def __init__(self, filters: list[Filter], ends: list[tuple[Callable[[object], None], _User]] | None = None):
        self.filters, self._ends = filters, ends or []

    def __getstate__(self) -> dict:
        return {"filters": self.filters, "_ends": []}  # contexts end where they were made

    def close(self) -> None:
        """Destroy the contexts of the user's filters, once."""
        ends, self._ends = self._ends, []
        for destroy, made in ends:
            destroy(made.context)

    def __call__(self, token: str) -> str | None:
        for f in self.filters:
            token = f(token)
            if not token:
                return None
        return token or None


def word_segments(text: Column, lang: str) -> Column:
    """Words of a text by the JVM's word boundaries of the language."""
    return F.flatten(F.sentences(text, F.lit(lang), F.lit("")))


def simple_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; the form that SQL can express."""
    return F.regexp_extract_all(F.lower(text), F.lit(SIMPLE_WORD), F.lit(0))


_EN = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers
herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has
had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor
not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
weren't won won't wouldn wouldn't"""
_DE = """aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des dich die dies dir doch dort du durch ein eine
einem einen einer eines er es euer für hatte hat hier ich ihr im in ist ja kann kein mein mich mir mit nach nicht noch nur ob oder ohne sein sich sie sind
so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur"""
_FR = """au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu
que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étés est sont suis"""
_ES = """de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también
me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él"""
STOPWORDS = {lang: frozenset(normalize(w) for w in words.split()) | frozenset(words.split()) for lang, words in (("en", _EN), ("de", _DE), ("fr", _FR), ("es", _ES))}
