"""Plain versions of the operators, for small inputs."""

from collections import Counter


def removed(texts, n):
    """For each text's bytes: which are covered by a string of n bytes that starts twice or more."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((r, bytes(gone)))
    return out


def runs(gone):
    return sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))


def components(fps, radius):
    """Least place of each class of fingerprints linked at ``radius`` bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def simhash(text, words):
    import re

    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
