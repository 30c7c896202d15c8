"""Brute-force versions of the operators' contracts."""

import collections
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string"
ODD = [(None, None, None, None), (1, "", "en", None), (2, " \n\t", None, "s"), (2, "a b", "en", "s"), (2, "a b", "en", "s")]


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i:i + 3])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def linked(rows, width, percent):
    """{(doc_id, n_shingles, component_id)} by comparing all sets that share a shingle."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower().decode() if text else "")
        w = [x.encode().lower() for x in w]
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    holders = collections.defaultdict(list)
    for i in sets:
        for s in sets[i]:
            holders[s].append(i)
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in sets:
        for j, k in collections.Counter(j for s in sets[i] for j in holders[s] if j < i).items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), root(i)) for i in sets}


def without_repeats(rows, least):
    """{(doc_id, text): text less later copies of line runs} for distinct rows."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seqs = [[(k, x, len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in order]
    first, gone = {}, [set() for _ in order]
    for p, s in enumerate(seqs):
        for i in range(len(s)):
            for m in range(1, len(s) - i + 1):
                first.setdefault(tuple(x[1] for x in s[i:i + m]), (p, i))
    for p, s in enumerate(seqs):
        for i in range(len(s)):
            for m in range(1, len(s) - i + 1):
                if first[tuple(x[1] for x in s[i:i + m])] < (p, i) and sum(x[2] for x in s[i:i + m]) >= least:
                    gone[p] |= {x[0] for x in s[i:i + m]}
    return {r: None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[p]) for p, r in enumerate(order)}


def raked(cells, targets, rounds):
    """IPF on {(source, lang, topic): weight}; targets: per dimension, {category: weight}."""
    now = dict(cells)
    for _ in range(rounds):
        for d in range(3):
            have = collections.Counter()
            for c, w in now.items():
                have[c[d]] += w
            now = {c: w * targets[d][c[d]] / have[c[d]] for c, w in now.items()}
    return now
