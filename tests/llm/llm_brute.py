"""Plain Python forms of two stages, for documents {id: text}."""

import hashlib

import xxhash


def line_chunks(lines, window=2, divisor=3):
    """Chunks of two lines or more: no two neighbours end one, nor does the last line but one."""
    hashes = [hashlib.md5(line.encode()).hexdigest() for line in lines]
    marks = [
        i >= max(window - 1, 1) and int(hashlib.md5("".join(hashes[i - window + 1 : i + 1]).encode()).hexdigest()[:7], 16) % divisor == 0
        for i in range(len(lines))
    ]
    start = 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (marks[i] and not marks[i - 1] and i < len(lines) - 2):
            yield lines[start : i + 1]
            start = i + 1


def lines_removed(texts, **cut):
    seen, out = set(), {}
    for doc_id in sorted(texts):
        kept = []
        for chunk in line_chunks((texts[doc_id] or "").split("\n"), **cut):
            if len(chunk) >= 2:
                if tuple(chunk) in seen:
                    continue
                seen.add(tuple(chunk))
            kept += chunk
        out[doc_id] = "\n".join(kept)
    return out


def fingerprint(text):
    words = text.encode().lower().split()
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_kept(texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    group = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())
