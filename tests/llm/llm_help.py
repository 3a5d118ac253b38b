"""Plain versions of what the pipeline decides."""

import collections
import re


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def near_components(rows, k, percent):
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for token in s:
            holders[token].append(i)
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(j for token in s for j in holders[token] if j < i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in rows}


def contaminated(text, bench, window=10):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    windows = set()
    for passage in bench:
        p = split(passage)
        windows |= {tuple(p[j : j + window]) for j in range(max(1, len(p) - window + 1) if p else 0)}
    w, sizes = split(text), {len(x) for x in windows}
    return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
