"""Plain versions of what the operators give."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=4):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows):
    """Index of the first row of each row's component, in the order given."""
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = top(i), top(j)
                    above[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(rows))], sets


def without_repeats(texts, length=35):
    """(n_words, n_removed, kept words) of each text."""
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def sha(parts):
    return hashlib.sha256(" ".join(parts).encode()).hexdigest()


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(runs)
    covered = {j for i, r in enumerate(runs) if count[r] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
