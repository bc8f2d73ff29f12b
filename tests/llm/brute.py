"""Plain Python versions of the operators, for small fixtures only."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def one_edit(a, b):
    if a == b:
        return False
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) - len(b) == 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def line_report(docs, min_words=1, near_words=8):
    """docs: (doc_id, text) with distinct ids. -> {doc_id: (n_lines, n_exact, n_near, n_kept)}"""
    lines = [(d, p, words(x)) for d, t in docs for p, x in enumerate((t or "").split("\n")) if len(words(x)) >= min_words]
    lines.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    out = {d: [0, 0, 0, 0] for d, _ in docs}
    seen = []
    exact = set()
    for d, _, w in lines:
        out[d][0] += 1
        if tuple(w) in exact:
            out[d][1] += 1
            continue
        exact.add(tuple(w))
        near = len(w) >= near_words and any(one_edit(w, v) for v in seen if len(v) >= near_words and abs(len(v) - len(w)) < 2)
        seen.append(w)
        out[d][2 if near else 3] += 1
    return {d: tuple(x) for d, x in out.items()}


def mix(docs, weights=(3, 1, 2), share=1.5, cap=2):
    """docs: (doc_id, text, source). -> {doc_id: (size, source_size, target, taken)}"""
    sizes = {d: len(words(t)) for d, t, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    total = {s: sum(sizes[d] for d, _, x in docs if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(cap * total[s]) for s in over}
        left -= sum(cap * total[s] for s in over)
        open_ -= over
    out = {}
    for s in sources:
        words_, start = int(target[s] + 0.5), 0
        own = sorted((hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest(), d) for d, t, x in docs if x == s)
        for _, d in own:
            passes, rest = divmod(words_, total[s]) if total[s] else (0, 0)
            out[d] = (sizes[d], total[s], target[s], passes * sizes[d] + max(0, min(sizes[d], rest - start)))
            start += sizes[d]
    return out


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_report(docs, k=4, percent=80):
    """docs: (doc_id, text) with distinct ids. -> {doc_id: (n_shingles, component_id, kept)}"""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1:]} if max(map(len, by.values()), default=0) < 400 else {
        (a, b) for a in sets for b in sets if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]


def url_rule(url, rules):
    """rules: (allow, host, path) -> (rule, verdict) or (None, None)"""
    host, path = url_parts(url)
    fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[1], "allow" if max(fit)[2] else "block") if fit else (None, None)
