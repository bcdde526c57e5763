"""Plain versions of the contracts, one row at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")


def rows(folder, table, *columns):
    return list(zip(*(pq.read_table(f"{folder}/{table}.parquet", columns=[c]).column(0).to_pylist() for c in columns)))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def remainder(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def rule_counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines, known, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in known
            known.add(line)
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside),
        n < 50 or 100 * len(inside) > 50 * n,
    )


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                found.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(found)


def digest(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def simhash(text):
    words = WORD.findall(lower(text or ""))
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, radius=2):
    """The root of each fingerprint."""
    parent = {f: f for f in fingerprints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    return {f: root(f) for f in parent}


def judge_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(host):]).group()
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def word_scores(texts, training):
    count = Counter()
    for text in training:
        count.update([*WORD.findall(lower(text or "")), " end"])
    n, v = sum(count.values()), len(count)
    made = []
    for text in texts:
        tokens = [*WORD.findall(lower(text or "")), " end"]
        made.append((len(tokens), sum(t in count for t in tokens), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)))
    return made


def ppm(texts, training, order, nodes, discount=0.5):
    """log10 probabilities by counting contexts in dictionaries, one symbol at a time."""
    ends = 256

    def symbols(text):
        return [ends] * order + list(lower(text or "").encode()) + [ends]

    levels = [Counter() for _ in range(order + 1)]
    positions = 0
    for text in training:
        s = symbols(text)
        for i in range(order, len(s)):
            positions += 1
            for k in range(order + 1):
                levels[k][tuple(s[i - k : i + 1])] += 1
    contexts = [{} for _ in range(order + 1)]
    totals = [Counter() for _ in range(order + 1)]
    for k, level in enumerate(levels):
        for gram, n in level.items():
            totals[k][gram[:-1]] += n
            if k == 0 or n * nodes >= positions:
                contexts[k].setdefault(gram[:-1], {})[gram[-1]] = n
    made = []
    for text in texts:
        s, score = symbols(text), 0.0
        for i in range(order, len(s)):
            excluded = set()
            for k in range(order, -1, -1):
                context = tuple(s[i - k : i])
                offered = contexts[k].get(context)
                if offered is None:
                    continue
                new = {x: n for x, n in offered.items() if x not in excluded}
                whole = totals[k][context] - sum(n for x, n in offered.items() if x in excluded)
                if s[i] in new:
                    score += math.log10((new[s[i]] - discount) / whole)
                    break
                escape = whole - sum(new.values()) + discount * len(new)
                if escape > 0:
                    score += math.log10(escape / whole)
                excluded |= set(offered)
            else:
                score -= math.log10(max(1, 257 - len(contexts[0].get((), {}))))
        made.append(score)
    return made


def exact_groups(rows):
    """``(id, keep, size, kept, sha)`` per row; of rows that repeat the kept id one is kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower(text or ""), []).append(doc_id)
    made = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            made.append((i, keep, len(ids), i == keep and not kept, sha(text)))
            kept = kept or i == keep
    return made


def rebuilt_conversations(rows, every=5, below=9):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % below
        made[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:]
    return made


def prefix_nodes(sequences):
    """Nodes by whole prefixes; each node adds to all of its own prefixes."""
    members, children, leaves, saved = {}, Counter(), Counter(), Counter()
    number, prefixes = {(): 0}, [()]
    for c, turns in sequences.items():
        at = 0
        members.setdefault(at, []).append(c)
        for turn in turns:
            if (at, turn) not in number:
                number[at, turn] = len(prefixes)
                prefixes.append((at, turn))
                children[at] += 1
            at = number[at, turn]
            members.setdefault(at, []).append(c)

    def upwards(at):
        while at:
            yield at
            at = prefixes[at][0]
        yield 0

    ends = {at: [] for at in members}
    for c, turns in sequences.items():
        at = 0
        for turn in turns:
            at = number[at, turn]
        ends[at].append(c)
    for at in members:
        weight = (len(members[at]) - 1) * len(prefixes[at][1][1].encode()) if at else 0
        for above in upwards(at):
            leaves[above] += not children[at]
            saved[above] += weight
    return [
        (
            min(convs), sum(1 for _ in upwards(at)) - 1, min(members[prefixes[at][0]]) if at else None, len(convs),
            children[at], leaves[at], saved[at], sha(",".join(map(str, sorted(ends[at])))),
        )
        for at, convs in members.items()
    ]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def best_documents(docs, items, k):
    """``(item, rank, doc, score)`` by scoring every document for every item."""
    counts = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    made = []
    for item, text in items:
        scored = []
        for (d, c), n in zip(counts, lengths, strict=True):
            m = 75 + 25 * n * n_docs // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in TERM.findall(lower(text or "")) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d))
        made += [(item, rank, d, -score) for rank, (score, _, d) in enumerate(sorted(scored)[:k], 1)]
    return made
