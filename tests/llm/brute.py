"""Plain versions of the corpus operators, for small tables."""

import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def repeats(texts, length):
    """(bytes, removed, runs, kept) per text."""
    raws = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, bytes(x for x, c in zip(b, cover) if not c)))
    return out


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(marked)


def covered(text, least):
    """Words in repeats of at least ``least`` words, and the longest repeat."""
    words = WORD.findall(text or "")
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best[i], best[j] = max(best[i], n), max(best[j], n)
    spans = {k for i, n in enumerate(best) if n >= least for k in range(i, i + n)}
    return len(spans), max([n for n in best if n >= least], default=0)


def shingles(text, size):
    words = WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def groups(rows, size):
    """key -> smallest key reachable over links of similarity 0.8."""
    sets, parent = {}, {}
    for key, text in rows:
        sets.setdefault(key, []).append(shingles(text, size))
        parent[key] = key

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(k, s) for k, many in sets.items() for s in many if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in parent}


def edits(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def secrets(text):
    found = []
    text = text or ""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in
                     ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [
        ("assign", f"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
    ]
    for order, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def word_scores(rows, modulus, remainder):
    """key -> (held out, tokens, known, training tokens, base score)."""
    out_of = lambda k: k is None or zlib.crc32(str(k).encode()) % modulus == remainder
    counts, documents = Counter(), 0
    for key, text in rows:
        if not out_of(key):
            counts.update(WORD.findall(lower(text)))
            documents += 1
    n, v = sum(counts.values()) + documents, len(counts) + (documents > 0)
    result = []
    for key, text in rows:
        words = WORD.findall(lower(text))
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((documents + 1) / (n + v + 1))
        result.append((key, out_of(key), len(words) + 1, sum(counts[w] > 0 for w in words) + (documents > 0), n, score))
    return result
