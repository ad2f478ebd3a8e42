"""Plain versions of the operators, for tests."""

import hashlib
import re

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def contamination(docs, items, window=10):
    """(doc, words, hit words, items, digest of their ids, contaminated) of each document."""
    out = []
    split = lambda t: _WORD.findall((t or "").translate(_UPPER))
    for doc, text in docs:
        own, hit, held = split(text), set(), set()
        for item, body in items:
            words = split(body)
            k = min(window, len(words))
            for j in range(len(words) - k + 1 if k else 0):
                for i in range(len(own) - k + 1):
                    if own[i : i + k] == words[j : j + k]:
                        hit.update(range(i, i + k))
                        held.add(str(item))
        ids = ",".join(sorted(held))
        out.append((doc, len(own), len(hit), len(held), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


_VALUE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _run(text, at, inside):
    end = at
    while end < len(text) and text[end] in inside:
        end += 1
    return end


def base_secrets(text):
    """(start, end, kind) of the three base kinds, letter by letter and without patterns."""
    low, out, at = text.translate(_LOWER), [], 0
    while at < len(text):
        end = None
        for name in _NAMES:
            if low.startswith(name, at):
                k = at + len(name)
                k += text[k : k + 1] in ("'", '"')
                k = _run(text, k, " ")
                if text[k : k + 1] in (":", "="):
                    k = _run(text, k + 1, " ")
                    k += text[k : k + 1] in ("'", '"')
                    stop = _run(text, k, _VALUE)
                    if stop > k:
                        end = stop
                        if stop - k >= 6:
                            out.append((at, stop, "assign"))
        at = end or at + 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = _run(text, at + 4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        if end == at + 4:
            at += 1
            continue
        if end - at >= 20:
            out.append((at, end, "access"))
        at = end
    at = 0
    while at < len(text):
        end = _run(text, at, "0123456789abcdef")
        if end - at >= 24:
            out.append((at, end, "hex"))
        at = max(end, at + 1)
    kinds = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[0], kinds.index(s[2])))
