"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(texts: list[str | None], length: int) -> list[tuple]:
    """(bytes, removed, spans, print of what is left) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(texts: dict[int, str | None], size: int, percent: int) -> dict[int, tuple]:
    """(set size, smallest linked id, whether it is the own id) per id."""
    sets, holders = {d: shingle_set(t, size) for d, t in texts.items()}, defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    root = {d: d for d in sets}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def targets(sizes: dict[str | None, int], weights: tuple, share: float, most: int) -> dict:
    """Target of each source, by resharing the excess round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        want = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and want[s] >= most * sizes[s]}
        if not over:
            return want
        full |= over
        if len(full) == len(order):
            return {s: most * sizes[s] for s in order}


def repaired(rows: list[tuple]) -> tuple:
    """Faults, cheapest edits and print of the repaired (turn, role, text) rows of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "sound" if end in ".!?" else "truncated")
        seen.add((role, text))
    # Cheapest first, and of equal cost the first audit: what comes out first at a place with some roles said is the best there.
    begun = re.compile(r"s?(ua)*u?")
    open_, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, turns = heapq.heappop(open_)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            break
        # What was said before the last turn makes no difference, but for whether anything was.
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        steps = [("I", 2, i, new, "") for new in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(open_, (cost + 3, audit + "D", i + 1, roles, turns))
            if faults[i] in ("sound", "truncated"):
                late = faults[i] == "truncated"
                steps += [("K", late, i + 1, role, text), *(("R", 2 + late, i + 1, new, text) for new in ("user", "assistant"))]
        for letter, more, after, role, text in steps:
            if role and begun.fullmatch(roles + role[0]) and roles + role[0] != "":
                heapq.heappush(open_, (cost + more, audit + letter, after, roles + role[0], (*turns, (role, text))))
    known = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest(),
    )


def _print(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_print(*fields) -> str:
    return _print(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple]]]:
    """The root over nodes, and for each node its siblings upwards as (on the left, print), None where there is none."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, k in zip(proofs, at):
            proof.append((k % 2 == 1, nodes[k ^ 1]) if k ^ 1 < len(nodes) else None)
        nodes, at = [_print(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], [k // 2 for k in at]
    return nodes[0], proofs


def manifest(rows: list[tuple]) -> list[tuple]:
    """Contract rows of (doc_id, source, lang, n_chars, text) rows."""
    groups, out = defaultdict(list), []
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, field_print(*row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (tree([n for _, _, n, _ in sorted(groups[g], key=lambda x: x[:3])]), sorted(groups[g], key=lambda x: x[:3])) for g in names}
    root, above = tree([trees[g][0][0] for g in names])
    for g, last in zip(names, above):
        (top, proofs), members = trees[g]
        for proof, (_, _, leaf, row) in zip(proofs, members):
            doc_id, source, lang, n_chars, text = row
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
                node = field_print(doc_id, source, lang, n_chars + 1, text)
            for step in proof + last:
                node = _print(node) if step is None else _print(step[1], node) if step[0] else _print(node, step[1])
            siblings = _print(*(s[1] for s in proof + last if s))
            out.append((doc_id, leaf, top, root, siblings, node, node == root))
    return out


SECRET_KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")


def secret_spans(text: str | None, reach: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Base spans, all reported ones, and (identifier, nearest secret, nearest endpoint), as (start, kind, end)."""
    text = text or ""
    flags = re.A | re.I
    given = "[\"']?\\x20*[:=]\\x20*[\"']?"
    value = "([A-Za-z0-9+/_.=-]+)"
    base = [(m.start(), 0, m.end()) for m in re.finditer(f"(password|passwd|secret|token|api_?key){given}{value}", text, flags) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    weak = [(m.start(), 3, m.end()) for m in re.finditer(f"(user(?:name)?|login|account|client_?id){given}([A-Za-z0-9@._+-]+)", text, flags) if len(m[2]) >= 3]
    weak += [
        (m.start(), 4, m.end())
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)
        if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])
    ]
    weak += [(m.start(), 5, m.end()) for m in re.finditer("[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\\s\"'<>]+", text)]
    weak = [w for w in weak if not any(w[0] < b[2] and b[0] < w[2] for b in base)]
    paragraph, lines = [], text.split("\n")
    number = 0
    for k, line in enumerate(lines):
        if k and not line.strip(" \t\r") and k < len(lines) - 1:
            number += 1
        paragraph += [number] * (len(line) + 1)

    def inside(part: tuple, who: tuple) -> bool:
        return who[0] - reach <= part[0] < who[2] + reach and paragraph[part[0]] == paragraph[who[0]]

    parts = base + weak
    who = [p for p in parts if p[1] in (1, 3)]
    secrets, places = [p for p in parts if p[1] in (0, 2, 4)], [p for p in parts if p[1] == 5]
    keep, links = set(base), []
    for i in who:
        mine = [s for s in secrets if inside(s, i)]
        if not mine:
            continue
        ends = [e for e in places if inside(e, i)]
        keep |= {i, *ends, *(s for s in mine if s[1] == 4)}

        def near(found: list[tuple]) -> tuple | None:
            return min(found, key=lambda p: (max(p[0] - i[2], i[0] - p[2]), p), default=None)

        links.append((i, near(mine), near(ends)))
    return sorted(base), sorted(keep), links


def languages(learned, texts, buckets=1 << 16, smoothing=0.5):
    """Plain multinomial naive Bayes over grams of one to three code points, told apart by the gram itself."""
    counts = {}
    for text, lang in learned:
        own = counts.setdefault(lang, Counter())
        own.update(grams(text))
    total = {lang: sum(own.values()) + smoothing * buckets for lang, own in counts.items()}
    out = []
    for text in texts:
        logs = {lang: sum(math.log((own[g] + smoothing) / total[lang]) for g in grams(text)) for lang, own in counts.items()}
        best = min(logs, key=lambda lang: (-logs[lang], lang))
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def grams(text):
    text = text.lower()
    return [text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]
