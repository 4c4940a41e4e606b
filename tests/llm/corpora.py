"""Small awkward tables and plain versions of the contracts."""

import hashlib
import re

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the quick brown fox jumps over a lazy dog while seven grey owls watch from an old barn near "
         "the river and nobody in the village has ever seen such a strange evening before winter").split()


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n).tolist() + [f"w{seed}"])


def awkward():
    """Nulls, empty and long texts, copies, near copies and repeated rows."""
    base = sentence(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [base, near, base, None, "", " \t\n", "one", sentence(2, 400), sentence(3, 30) * 40,
             base.upper(), "é" * 150 + base, sentence(4, 50) + base[:300] + sentence(5, 50), "x" * 250]
    rows = [(10 * i, t, "en", "s", None) for i, t in enumerate(texts)]
    return [*rows, (20, base, None, None, 7), (None, base, "en", "s", 1), (None, "alone here", "en", "s", 1)]


def unique_ids():
    return [r for i, r in enumerate(awkward()) if r[0] is not None and i != 13]


def fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(nodes, near):
    """Least member of the component of each node."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i], nodes[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


def without_repeats(rows, length=100):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by doc_id, for unique ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            piece = data[p:p + length]
            if piece in seen:
                gone[p:p + length] = True
            seen.add(piece)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "phone": 9 <= len(digits) <= 15,
                    "card": 13 <= len(digits) <= 19 and luhn(digits),
                    "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out
