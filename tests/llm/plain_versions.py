"""Plain versions the tests compare with."""


def components_of(nodes, linked):
    """Smallest node reachable from each."""
    names, root = sorted(nodes), {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_lines(texts, n):
    seen, starts = set(), []
    for d, text in enumerate(texts):
        lines = text.split("\n")
        items = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        for p in range(len(items) - n + 1):
            key = tuple(lines[i] for i in items[p:p + n])
            if key in seen:
                starts.append((d, items[p], items[p + n] if p + n < len(items) else len(lines)))
            seen.add(key)
    out = {}
    for d, text in enumerate(texts):
        lines = text.split("\n")
        gone = {i for e, a, b in starts if e == d for i in range(a, b)}
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out
