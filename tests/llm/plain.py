"""Plain versions of what the operators compute, on lists of rows."""

import collections
import hashlib
import re

BLANK = re.compile(r"[\x20\x09-\x0D]+")
UNBLANK = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter_words(text):
    return LETTERS.findall((text or "").translate(FOLD))


def blank_words(text):
    return UNBLANK.findall((text or "").translate(FOLD))


def shingles(text, size=5):
    words = letter_words(text)
    if not words:
        return collections.Counter()
    return collections.Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(keys, pairs):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def removed_bytes(texts, length=400):
    """(bytes, removed, spans, sha256 of the rest) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
