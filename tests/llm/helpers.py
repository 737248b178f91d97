"""Plain versions of the operators, and a table with the awkward cases."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key long, bucket long"


def prose(seed: int, n: int) -> str:
    words = []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        words.append("abcdefgh"[seed >> 61] * (1 + (seed >> 40) % 4) + "xyz"[(seed >> 33) % 3] + str((seed >> 50) % 50))
    return " ".join(words)


def awkward():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows, and columns with the names that operators use inside."""
    base, passage = prose(1, 120), prose(2, 60)
    texts = [
        base, base, base.replace("xyz", "x", 1) + " more", prose(3, 40) + "\n" + passage, passage + " é ü " + prose(4, 30), None, "", "   \n\t", "one", "one", "One two three",
        prose(5, 6000), prose(6, 25) + " " + prose(6, 25), "ÀÉ ß Σς İ ｗide ７ a's we'll <|endoftext|> don't", "l\nl\nl\n \nm", "x" * 3000, prose(7, 100), prose(7, 100).upper(), "\x0b\x1c\x85 a\u00a0b",
    ]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), -1, -2, -3) for i, t in enumerate(texts)]
    rows.append(rows[3])
    rows.append((None, prose(8, 30), None, None, None, None, None, None))
    rows.append((None, base, None, None, None, None, None, None))
    return rows


def links(rows, n=5, percent=80):
    """(n_shingles, component) of each row, by all pairs."""
    sets = []
    for _, text, *_ in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        ids = [x for x in (least.get(find(i)), row[0]) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def without_repeats(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha256) of each row."""
    first = {}
    order = [1 << 62 if r[0] is None else r[0] for r in rows]
    for i in sorted(range(len(rows)), key=lambda i: order[i]):
        data = (rows[i][1] or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], order[i])
    out = []
    for i, row in enumerate(rows):
        data = (row[1] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < order[i]:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    repeated = {x for v in places.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)
