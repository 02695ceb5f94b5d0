"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re
import zlib

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def exact(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(WHITE, "", text or "")].append((-len(text or ""), i))
    out = {}
    for form, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(form.encode()).hexdigest())
    return out


def shingles(text):
    words = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 9 <= len(number) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s[2] for s in sorted(out)]


def quality(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def alignment(rows, first, second, a_bytes, b_bytes):
    """Alignments by sets of byte offsets; ``first`` and ``second`` give a text's ids, the tables their bytes."""
    docs = []
    for i, text in rows:
        a, b = (first(" " + text), second(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(a_bytes[x] for x in a) != raw or b"".join(b_bytes[x] for x in b) != raw:
            a, b = [], []
        ends = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for x in ids:
                at += len(table[x])
                out.append(at)
            ends.append(out)
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[x for x, e in zip(ids, es) if low < e <= cut] for ids, es in zip((a, b), ends)])
            low = cut
        links = collections.Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        form = ";".join("|".join(",".join(map(str, part)) for part in g) for g in groups)
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(form.encode()).hexdigest() if groups else ""))
    count = collections.Counter(p for d in docs for p in d[4])
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(i, na, nb, g, sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()), sha)
            for i, na, nb, g, links, sha in docs]


def spelling(rows):
    """Words, near words by pairs of deletion sets, forms and roots, with plain loops."""
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    without = {w: {w[:k] + w[k + 1:] for k in range(len(w))} for w in words}
    near = {w: [v for v in words if v != w and (
        len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 1 or len(v) == len(w) - 1 and v in without[w] or len(v) == len(w) + 1 and w in without[v])] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def secret_base(text):
    """Base spans by the plain patterns."""
    text, out = text or "", []
    for order, (kind, pattern) in enumerate({
            "assign": r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.items()):
        for m in re.finditer(pattern, text):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def secret_links(parts, reach):
    """Weak candidates (kind, role, strong, start, end, paragraph) that every other part of their paragraph is held against."""
    out = set()
    for kind, role, strong, start, end, paragraph in parts:
        if strong:
            continue
        near = [p for p in parts if p[5] == paragraph and p[1] != role and p[3] - end <= reach and start - p[4] <= reach]
        others = [p for p in near if p[1] != "endpoint"]
        if any(p[2] for p in others) or others and any(p[1] == "endpoint" for p in near):
            out.add((kind, start, end))
    return out
