"""Plain versions of operators for small tables."""

import itertools
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def components_of(sets, percent):
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(k for k in sets if sets[k]), 2):
        x, y = sets[a], sets[b]
        if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                a, b = sorted((root(a), root(b)))
                parent[b] = a
    return {k: root(k) for k in sets}


def removed_runs(texts, length):
    seen, out = set(), {}
    for doc, text in texts:
        body = (text or "").encode()
        covered = bytearray(len(body))
        for i in range(len(body) - length + 1):
            part = body[i : i + length]
            if part in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(part)
        edges = [i for i in range(len(body) + 1) if (covered[i - 1] if i else 0) != (covered[i] if i < len(body) else 0)]
        out[doc] = list(zip(edges[::2], edges[1::2]))
    return out


def packed_ids(texts, name="word_bpe_49k.json"):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path(name))
    return {doc: encoder.encode(text or "", add_special_tokens=False).ids + [1] for doc, text in texts.items()}


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def hit_words(text, items, span=13):
    """(hit words, ids of the items found) of a text; items: (id, text)."""
    words = bench_words(text)
    hit, found = set(), set()
    for item, body in items:
        own = bench_words(body)
        n = min(span, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(hit), sorted(found)


def kept_lines(rows, limits):
    """{doc: text} of what quality rules leave; rows: (doc, host, text)."""

    def normal(line):
        return re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip(" ")

    holders, hosts = {}, {}
    for _, host, text in rows:
        hosts.setdefault(host, set()).add(text or "")
        for line in (text or "").split("\n"):
            holders.setdefault((host, normal(line)), set()).add(text or "")
    out = {}
    for doc, host, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        starts = {}
        for i in range(len(words) - 7):
            starts.setdefault(tuple(words[i : i + 8]), []).append(i)
        repeated = {k for at in starts.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
            continue
        lines, gone = [], 0
        for line in (text or "").split("\n"):
            plain, n = normal(line), len(holders[host, normal(line)])
            size = len(plain.split(" ")) if plain else 0
            if size >= limits.min_line_words and n > limits.max_documents and n * 100.0 > len(hosts[host]) * limits.max_share_percent:
                gone += size
            else:
                lines.append(line)
        if 100 * (len(words) - gone) >= limits.min_left_percent * len(words):
            out[doc] = "\n".join(lines)
    return out


def optimal_bins(sizes, room):
    """Fewest bins, by trying every bin for each piece."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for free in sorted(set(bins)):
            if free >= sizes[k]:
                rest = list(bins)
                rest.remove(free)
                place(k + 1, [*rest, free - sizes[k]])
        place(k + 1, [*bins, room - sizes[k]])

    place(0, [])
    return best[0]
