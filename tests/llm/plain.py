"""Plain versions of the training-data operators: one row, one word, one window at a time."""

import base64
import collections
import math
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rules(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = collections.Counter(runs)
    covered = set()
    for i, r in enumerate(runs):
        if count[r] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def trusted(text):
    n, chars, symbols, dup, repeat = rules(text)
    return n >= 30 and dup == 0 and 20 * repeat <= n and 50 * symbols <= n and chars <= 12 * n


def shape(word):
    """None, or the last character's kind (0: no symbol) by 1, 2 or more symbols."""
    n = min(3, sum(c in "#*$%&|<>" for c in word))
    return ("#*$%&|<>".find(word[-1]) + 1, n) if n else None


def ratios(texts):
    """A function from text to the mean log ratio, with the operator's own hash for the buckets only."""
    from arbora.llm import blocks as B
    from arbora.llm import quality_rules as Q

    hashes = {}

    def grams(text):
        words = WORD.findall(text or "")
        for w in words:
            if w not in hashes:
                raw = np.frombuffer(w.encode(), np.uint8)
                hashes[w] = B.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
        shift = np.uint64(64 - int(math.log2(Q.BUCKETS)))
        for w in words:
            yield int(hashes[w] >> shift), ("word", shape(w))
        for a, b in zip(words, words[1:]):
            both = B.windows(np.array([hashes[a], hashes[b]]), np.array([0, 2]), 2, seed=5)[0][0]
            yield int(both >> shift), ("same",) if a == b else ("pair", shape(a), shape(b))

    counts = [[collections.Counter(), collections.Counter()] for _ in range(2)]
    for t in texts:
        good = trusted(t)
        for gram in grams(t):
            for k in range(2):
                counts[k][0][gram[k]] += 1
                counts[k][1][gram[k]] += good
    sizes = Q.BUCKETS, Q.SHAPES
    total = [[sum(c.values()) + n for c in pair] for pair, n in zip(counts, sizes)]

    def llr(text):
        found = [sum(math.log((counts[k][1][g[k]] + 1) / total[k][1]) - math.log((counts[k][0][g[k]] + 1) / total[k][0]) for k in range(2)) for g in grams(text)]
        return sum(found) / max(1, len(found))

    return llr


def features(text):
    """The quality classifier's numbers, in the order of its FEATURES."""
    raw = (text or "").encode()
    words = [w.encode() for w in WORD.findall(text or "")]
    n, solid = max(1, len(words)), max(1, sum(map(len, words)))
    share = lambda chars: sum(c in chars for c in raw) / solid
    _, _, _, dup, repeat = rules(text)
    lines = raw.count(b"\n") + 1
    return [
        math.log1p(len(raw)), sum(map(len, words)) / n, sum(len(w) > 16 for w in words) / n, share(range(65, 91)), share(range(48, 58)), share(b"#*$%&|<>"), share(b"!?"), share(b".,;:'\"()-"),
        share(range(128, 256)), sum(w[-1] in b"#*$%&|<>!?" for w in words) / n, len(words) / lines, dup / lines, repeat / n, len(set(words)) / n, len(set(zip(words, words[1:]))) / n,
    ]


def additive_score(model, x):
    f = model.base + sum(model.tables[j][sum(v >= e for e in model.edges[j])] for j, v in enumerate(x))
    for (i, j), table in model.pairs.items():
        f += table[sum(x[i] >= e for e in model.coarse[i]), sum(x[j] >= e for e in model.coarse[j])]
    return 1 / (1 + math.exp(-max(-30, min(30, f))))


def components(rows):
    """id to (number of shingles, smallest id reachable over links of similarity 0.75)."""
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = collections.defaultdict(list)
    for d in sorted(sets):
        shared = collections.Counter(o for s in sets[d] for o in places[s])
        for o, i in shared.items():
            if 100 * i >= 75 * (len(sets[d]) + len(sets[o]) - i):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
        for s in sets[d]:
            places[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


TERM = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def leaks(docs, items, retrieve=0.6, question=0.6, answer=0.6, k1=1.2, b=0.75):
    """{(doc id, item id): (score, question overlap, answer overlap)} by scoring every passage with every item."""
    terms = lambda t: TERM.findall((t or "").translate(FOLD))
    triples = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    held = [(i, t, terms(t)) for i, t in dict.fromkeys(items) if terms(t)]
    df = collections.Counter(w for _, _, ws in held for w in set(ws))
    mean = sum(len(ws) for _, _, ws in held) / max(1, len(held))
    idf = {w: math.log1p((len(held) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    made = []
    for i, t, ws in held:
        weight = {w: idf[w] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / mean)) for w, tf in collections.Counter(ws).items()}
        total = sum(weight.values())
        parts = [p for p in map(terms, re.findall(r"[^.?!\n]+", t)) if p]
        cut = max(1, len(parts[0]) * 3 // 4)
        sides = (sum(parts[:-1], []), parts[-1]) if len(parts) > 1 else (parts[0][:cut], parts[0][cut:])
        made.append((i, {w: x / total for w, x in weight.items()}, sides))
    step = max([32, *(len(ws) for _, _, ws in held)])
    out = {}
    for d, text in docs:
        ws = terms(text)
        for k in range(max(1, -(-len(ws) // step) - 1) if ws else 0):
            passage = ws[k * step : k * step + 2 * step]
            inside = set(passage)
            for i, weight, sides in made:
                score = sum(x for w, x in weight.items() if w in inside)
                if score < retrieve * (1 - 1e-9):
                    continue
                overlaps = []
                for side in sides:
                    width = max(1, min(3, len(side)))
                    own = triples(side, width)
                    overlaps.append(len(own & triples(passage, width)) / len(own) if own else 1.0)
                if overlaps[0] >= question and overlaps[1] >= answer:
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (round(score, 9), *overlaps))
    return out


def base_secrets(text):
    """(start, kind's place, end) of the fixed patterns."""
    kinds = (
        (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m))


def entropy_windows(run, threshold, width=20):
    """Positions of a run that lie in a window whose entropy, counted anew, reaches the threshold."""
    hit = set()
    for i in range(len(run) - width + 1):
        counts = collections.Counter(run[i : i + width])
        if -sum(c / width * math.log2(c / width) for c in counts.values()) >= threshold - 1e-9:
            hit.update(range(i, i + width))
    return hit


def secret_positions(text):
    """All positions (code points) under a pattern, or in an unexplained run's window of high entropy."""
    from arbora.llm import secret_scan as S

    base = base_secrets(text)
    hit = {p for a, _, b in base for p in range(a, b)}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0].encode()
        kind = S._char_class(run)
        if kind is None or any(p.fullmatch(run) for p in S.ALLOWED):
            continue
        for p in sorted(entropy_windows(m[0], S.THRESHOLDS[kind])):
            at = m.start() + p
            # words before an assignment are the rest of its key's name
            after = [(a, k) for a, k, _ in base if a > at]
            name = after and after[0][1] == 0 and after[0][0] < m.end() and S.ALLOWED[2].fullmatch(text[m.start() : after[0][0]].encode())
            if not name:
                hit.add(at)
    return hit


def tokenizer():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def language_probabilities(model, text, width=48):
    """Mean over the bytes, window by window, byte by byte."""
    raw, total = text.encode(), 0
    h = model.h
    gate = lambda x: np.clip(0.25 * x + 0.5, 0, 1)
    for lo in range(0, len(raw), width):
        window = raw[lo : lo + width].ljust(width)
        states = []
        for d, order in ((0, range(width)), (1, range(width - 1, -1, -1))):
            table, back = model.p["table"][d].astype(float), model.p["back"][d].astype(float)
            s, seen = np.zeros(h), {}
            for t in order:
                x = table[window[t]]
                z, r = gate(s @ back[:, :h] + x[:h]), gate(s @ back[:, h : 2 * h] + x[h : 2 * h])
                c = np.clip((r * s) @ back[:, 2 * h :] + x[2 * h :], -1, 1)
                s = s + z * (c - s)
                seen[t] = s
            states.append(seen)
        for t in range(min(width, len(raw) - lo)):
            logits = np.concatenate([states[0][t], states[1][t]]) @ model.p["out"] + model.p["bias"]
            e = np.exp(logits - logits.max())
            total = total + e / e.sum()
    return total / len(raw)
