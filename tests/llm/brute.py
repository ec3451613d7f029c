"""Plain versions that results are held against."""


def components(nodes, links):
    """The smallest node that each can reach."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def shingle_set(text, width=5):
    words = (text or "").split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
