"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def union_find(nodes, edges):
    up = {k: k for k in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {k: root(k) for k in nodes}


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard(docs):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {k: shingles(t) for k, t in docs}
    ids = sorted(sets)
    inverse = defaultdict(list)
    for k in ids:
        for s in sets[k]:
            inverse[s].append(k)
    both = defaultdict(int)
    for group in inverse.values():
        for i, b in enumerate(group):
            for a in group[:i]:
                both[a, b] += 1
    links = [p for p, o in both.items() if 100 * o >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - o)]
    root = union_find(ids, links)
    return {k: (len(sets[k]), root[k]) for k in ids}


def substring(docs, window=20):
    """{doc_id: (n_words, n_removed, digest)}"""
    seen, out = set(), {}
    for k, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone[i : i + window] = [True] * window
            else:
                seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def exact(docs):
    """{doc_id: (keep_id, group_size, digest)}"""
    groups = defaultdict(list)
    for k, t in docs:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), k))
    out = {}
    for text, rows in groups.items():
        keep = min(rows)[1]
        for _, k in rows:
            out[k] = (keep, len(rows), hashlib.sha256(text.encode()).hexdigest())
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


# -- quotation linking --------------------------------------------------------------------------------


def _normal(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def _level(line):
    """(quote level, what is said after the marks)."""
    at = level = 0
    for i, c in enumerate(line):
        if c == ">":
            level, at = level + 1, i + 1
        elif c not in " \t":
            break
    return level, _normal(line[at:])


def own_lines(text):
    """Lines of a text that are no quotes and announce none."""
    lines = text.split("\n")
    out = []
    for i, line in enumerate(lines):
        announces = re.search(r"(?:wrote|writes|schrieb|écrit|escribió):[ \t\r]*$", line) and ">" not in line and i + 1 < len(lines) and _level(lines[i + 1])[0]
        if not _level(line)[0] and not announces:
            out.append(line)
    return out


def quote_links(messages):
    """{(conv, turn): (reply_to, quotes, linked, outside)} and {conv: turns in reply order} of messages (conv, turn, text), one of each turn."""
    says = defaultdict(dict)  # said -> conversation -> first turn
    for conv, turn, text in messages:
        own = "\n".join(own_lines(text))
        for unit in {_normal(u) for u in [own, *re.split(r"\n[ \t\r]*\n", own), *own.split("\n")]} - {""}:
            says[unit][conv] = min(turn, says[unit].get(conv, turn))

    def source(conv, turn, said):
        first = says[said].get(conv)
        if first is not None and first < turn:
            return True, (conv, first)
        others = sorted((c, t) for c, t in says[said].items() if c != conv)
        return (False, others[0]) if others else None

    told = {}
    for conv, turn, text in messages:
        passages, before = [], None
        for place, (level, said) in enumerate(map(_level, text.split("\n"))):
            if level != before:
                passages.append((level, place, []))
            before = level
            if level and said:
                if not passages[-1][2]:
                    passages[-1] = (level, place, [])
                passages[-1][2].append(said)
        quotes = linked = outside = 0
        replies = []
        for level, place, lines in passages:
            if not lines:
                continue
            quotes += 1
            votes = defaultdict(int)
            for whole, units in ((True, [" ".join(lines)]), (False, set(lines))):
                for unit in units:
                    if (got := source(conv, turn, unit)) is not None:
                        votes[whole, got[0], got[1]] += 1
            if votes:
                linked += 1
                (_, inside, (c, t)), _ = max(votes.items(), key=lambda v: (v[0][0], v[0][1], v[1], v[0][2][1], v[0][2]))
                if inside:
                    replies.append((level, -place, t))
                else:
                    outside += 1
        told[conv, turn] = (min(replies)[2] if replies else None, quotes, linked, outside)
    order = {}
    for conv in {c for c, _, _ in messages}:
        turns = sorted(t for c, t, _ in messages if c == conv)
        paths, branch, heads = {}, None, {None: []}
        of = {}
        for t in turns:
            to = told[conv, t][0]
            if to is not None and to != t - 1:
                heads[t], branch = [*heads[of[to]], to, t], t
            of[t] = branch
            paths[t] = [*heads[branch], t]
        order[conv] = sorted(turns, key=paths.get)
    return told, order


# -- disclosure -----------------------------------------------------------------------------------------


def least_share(k, n, z=1.645):
    """Lower confidence bound of a share: Wilson's, with continuity correction."""
    p = k / n
    root = max(z * z - 2 - 1 / n + 4 * p * (n * (1 - p) + 1), 0) ** 0.5
    return max((2 * k + z * z - 1 - z * root) / (2 * (n + z * z)), 0.0)


def disclosures(docs, z=1.645):
    """{(entity, term): disclosure} of all terms that share a line with an entity; docs: (id, text)."""
    term = re.compile(r"[^\W_](?:[\w'-])*")
    n_t, contexts, total = defaultdict(int), defaultdict(lambda: defaultdict(int)), 0
    for _, text in docs:
        for line in (text or "").split("\n"):
            total += 1
            spans = sorted(((kind, *map(int, rest.split(":"))) for kind, rest in (x.split(":", 1) for x in pii(line))), key=lambda s: s[1])
            rest, at = "", 0
            for _, a, b in spans:
                rest += line[at : max(a, at)] + " "
                at = max(at, b)
            rest += line[at:]
            for w in {w.lower() for w in term.findall(rest)}:
                n_t[w] += 1
            for e in {f"{kind}:{line[a:b]}" for kind, a, b in spans}:
                contexts[e][rest] += 1
    out = {}
    for e, said in contexts.items():
        base = len(said) / total
        joint = defaultdict(list)
        for rest, times in said.items():
            for w in {w.lower() for w in term.findall(rest)}:
                joint[w].append(times)
        for w, times in joint.items():
            n = max(n_t[w] - sum(times) + len(times), len(times))
            out[e, w] = max((least_share(len(times), n, z) - base) / (1 - base), 0.0) if base < 1 else 0.0
    return out
