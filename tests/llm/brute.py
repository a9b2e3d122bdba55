"""Plain versions of the operators' contracts, for small inputs."""

import base64
import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def simhash(text, width=3):
    found = words((text or "").translate(UPPER))
    if not found:
        return 0
    k = min(width, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i:i + k]).encode(), 42) for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(prints, max_bits=2):
    """{doc_id: smallest id reachable} of {doc_id: fingerprint}."""
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if bin(prints[a] ^ prints[b]).count("1") <= max_bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def shingle_set(text, width=5):
    found = words((text or "").translate(UPPER))
    k = min(width, len(found))
    return {" ".join(found[i:i + k]) for i in range(len(found) - k + 1)} if found else set()


def kept_ids(docs, similarity=0.8):
    """Smallest id of each group that near fingerprints or similar shingle sets connect, of [(doc_id, text)]."""
    group = component_ids({d: simhash(t) for d, t in docs})
    sets = {d: shingle_set(t) for d, t in docs}
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if shared and shared / len(sets[a] | sets[b]) >= similarity and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return sorted(set(group.values()))


def line_report(docs):
    """{doc_id: (n_lines, n_dropped, sha256)} of [(doc_id, text)]."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def base_metrics(text):
    found = words(text)
    windows = defaultdict(list)
    for i in range(len(found) - 4):
        windows[tuple(found[i:i + 5])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(found)
    return (n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated),
            n < 10 or 100 * len(repeated) > 20 * n)


def warc_rows(pages):
    """{page_id: (bytes, digest, type, refers_to)} of [(page_id, html)] with different ids."""
    first = {}
    for p, html in sorted(pages):
        first.setdefault(html or "", p)
    out = {}
    for p, html in pages:
        data = (html or "").encode()
        same = first[html or ""]
        out[p] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                  "response" if same == p else "revisit", None if same == p else same)
    return out


def split_url(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(UPPER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def url_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)
