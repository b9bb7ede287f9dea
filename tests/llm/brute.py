"""Plain single-machine versions of what the operators compute."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    n = min(width, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard_components(rows, low=75, high=100):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, by comparing all sets that share a shingle."""
    sets = [shingles(text) for _, text in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        overlap = Counter(j for x in s for j in holders[x] if j < i)
        for j, o in overlap.items():
            if high * o >= low * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(
        ((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr
    )


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if counts[r] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def url_verdict(url, rules, default="allow"):
    """host, path, rule, verdict."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = lower(host)
    fits = [
        (len(h) + len(p), len(h), h + p, a)
        for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[2], best[3]


KEY = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k)
    for k in ("password", "passwd", "secret", "token", "api_?key")
)
SECRETS = [
    ("assign", re.compile(rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(m):
    return re.sub(r"[^0-9]", "", m[0])


PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (
        "ip",
        re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        lambda m: all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")),
    ),
    (
        "card",
        re.compile(r"[0-9]([\x20-]?[0-9])+"),
        lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m)),
    ),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(_digits(m)) <= 15),
]


def spans(text, kinds):
    """(start, place of the kind, kind, end) by start, then kind."""
    found = []
    for rank, (kind, pattern, passes) in enumerate(kinds):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if passes(m)]
    return sorted(found)


def listed(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)


def digest(found):
    return hashlib.sha256(listed(found).encode()).hexdigest()
