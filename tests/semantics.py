"""The planners once more, in the plainest form, to test the others against."""


def delimited(data: bytes, size: int, pattern: bytes) -> list[tuple[int, int]]:
    out, start, step = [], 0, max(size, 1)
    while start < len(data):
        found = data.find(pattern, start + step) if start + step < len(data) else -1
        end = len(data) if found < 0 else found + len(pattern)
        out.append((start, end))
        start = end
    return out


def fixed(data: bytes, size: int) -> list[tuple[int, int]]:
    step = max(size, 1)
    return [(s, min(s + step, len(data))) for s in range(0, len(data), step)]


def partition(data: bytes, parts: int, byte: int) -> list[tuple[int, int]]:
    return [(s, e) for _, _, s, e in multi([data], parts, byte)]


def multi(sources: list[bytes], parts: int, byte: int) -> list[tuple[int, int, int, int]]:
    """(worker, source, start, end) over an ordered list of sources."""
    total = sum(map(len, sources))
    prefix = [sum(map(len, sources[:k])) for k in range(len(sources) + 1)]
    n, last, cuts = min(parts, total), 0, []
    for i in range(1, n):
        aim = total * i // n
        if aim <= last:
            continue
        edge = aim
        if aim not in prefix:
            k = max(j for j in range(len(sources)) if prefix[j] <= aim and len(sources[j]))
            found = sources[k].find(bytes([byte]), aim - prefix[k])
            edge = prefix[k] + (len(sources[k]) if found < 0 else found + 1)
        if edge <= last:
            continue
        if edge == total:
            break
        cuts.append(edge)
        last = edge
    edges, out = [0, *cuts, total], []
    for w in range(len(edges) - 1 if total else 0):
        for k in range(len(sources)):
            s, e = max(edges[w], prefix[k]), min(edges[w + 1], prefix[k + 1])
            if s < e:
                out.append((w, k, s - prefix[k], e - prefix[k]))
    return out
