"""Counts over words, lines and characters of whole texts, per document, vectorised."""

from __future__ import annotations

import re

import numpy as np

from ledgerline.llm.textbatch import Words, mix


def _mask(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in characters]] = True
    return out


SYMBOLS = _mask("#*$%&|<>")
NOISE = _mask("#*$%&|<>!")
#: Bytes of words that are more than separators: letters, digits, anything beyond ASCII.
SOLID = np.ones(256, dtype=bool)
SOLID[:48] = SOLID[58:65] = SOLID[91:97] = SOLID[123:128] = False
#: Characters that end a sentence or a quotation, as UTF-8.
TERMINAL = _mask(".!?:;\"')]")
TERMINAL_WIDE = ("…", "”", "’", "»", "。")
#: Phrases of site boilerplate in the corpus's languages, lower-case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "log in", "powered by", "privacy policy", "read more",
    "sign in", "sign up", "skip to content", "subscribe now", "terms of service", "terms of use", "unsubscribe",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookies akzeptieren", "datenschutzerklärung", "impressum", "jetzt abonnieren",
    "jetzt anmelden", "mehr erfahren", "passwort vergessen", "weiterlesen", "zum inhalt springen",
    "accepter les cookies", "aller au contenu", "conditions d'utilisation", "lire la suite", "mentions légales", "mot de passe oublié",
    "politique de confidentialité", "se connecter", "se désabonner", "tous droits réservés",
    "aceptar cookies", "aviso legal", "iniciar sesión", "ir al contenido", "leer más", "política de privacidad", "suscríbete", "todos los derechos reservados", "términos de uso",
)


def phrase_pattern() -> str:
    """BOILERPLATE as alternatives, the same in any engine: case is ignored for ASCII by option, for other letters by both."""
    both = lambda c: f"(?:{c}|{c.upper()})" if not c.isascii() else re.escape(c) if not c.isalnum() and c not in " '" else c
    return "|".join("".join(map(both, p)) for p in BOILERPLATE)


_PHRASES = re.compile(phrase_pattern().encode(), re.IGNORECASE)


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True bytes in each document."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """Per document: words in windows of ``size`` words that the document has twice or more."""
    at, window = words.windows(size)
    doc = words.doc[at].astype(np.uint64)
    key = mix(window + doc * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begin = at[twice]
    step = np.zeros(len(words.start) + 1, dtype=np.int64)
    step[begin] += 1
    step[begin + size] -= 1
    return np.bincount(words.doc[np.cumsum(step[:-1]) > 0], minlength=words.n_docs)


class Lines:
    """The lines that have a word: document numbers, byte spans, word ranges."""

    def __init__(self, words: Words):
        breaks = np.flatnonzero(words.data == 10)
        of_break = np.searchsorted(words.offsets, breaks, "right") - 1
        start = np.concatenate((words.offsets[:-1], breaks + 1))
        doc = np.concatenate((np.arange(words.n_docs), of_break))
        after = np.append(breaks, len(words.data))[np.searchsorted(breaks, start)]
        end = np.minimum(after, words.offsets[doc + 1])
        low, high = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
        has = np.flatnonzero((high > low) & (end > start))
        has = has[np.argsort(start[has], kind="stable")]
        self.words = words
        self.doc, self.start, self.end, self.low, self.high = doc[has], start[has], end[has], low[has], high[has]
        self.n_words = self.high - self.low

    def duplicates(self) -> np.ndarray:
        """Per document: lines equal to an earlier one."""
        w = self.words
        key = mix(w.span_hash(self.start, self.end) + self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.zeros(len(key), dtype=bool)
        first[np.unique(key, return_index=True)[1]] = True
        return np.bincount(self.doc[~first], minlength=w.n_docs)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """True bytes in each line."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[self.end] - total[self.start]

    def bare(self) -> np.ndarray:
        """Words of each line that have only separators."""
        w = self.words
        total = np.concatenate(([0], np.cumsum(SOLID[w.data])))
        empty = np.concatenate(([0], np.cumsum(total[w.end] == total[w.start])))
        return empty[self.high] - empty[self.low]

    def terminal(self) -> np.ndarray:
        """Whether the last word ends a sentence or a quotation."""
        w = self.words
        last, n = w.end[self.high - 1], len(w.data)
        out = TERMINAL[w.data[last - 1]]
        for c in TERMINAL_WIDE:
            raw = c.encode()
            hit = np.full(len(last), n > 0)
            for k, b in enumerate(raw):
                hit &= w.data[np.maximum(last - len(raw) + k, 0)] == b
            out = out | hit
        return out

    def boilerplate(self) -> np.ndarray:
        """Whether the line has a boilerplate phrase."""
        out = np.zeros(len(self.start), dtype=bool)
        if len(out):
            found = np.array([m.start() for m in _PHRASES.finditer(self.words.data.tobytes())], dtype=np.int64)
            line = np.searchsorted(self.start, found, "right") - 1
            out[line[(line >= 0) & (found < self.end[line])]] = True
        return out
