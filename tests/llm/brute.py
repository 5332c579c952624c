"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", low(text)), None]


def repeats(rows, size=100):
    """By (id, text): (n_bytes, n_removed, n_spans, kept bytes), for distinct rows in the order of ids."""
    seen, out = {}, {}
    for key, raw in rows:
        for p in range(len(raw) - size + 1):
            seen.setdefault(raw[p : p + size], (key, p))
    for key, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            if seen[raw[p : p + size]] < (key, p):
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return out


def contamination(docs, items, window=10):
    found = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[k : k + window])].add("" if i is None else str(i))
    sizes, out = sorted({len(w) for w in found}), []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in found:
                    hit.update(range(k, k + n))
                    names |= found[g]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def shingle_weights(rows):
    """By row the weight of each shingle: its count times the mean inverse document frequency of its words."""
    n, sets = len(rows), []
    df = Counter(w for t in rows for w in set(words(t)))
    for t in rows:
        w = words(t)
        k = min(5, len(w))
        grams = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else Counter()
        sets.append({g: c * sum(math.log((n + 1) / (df[x] + 1)) + 1 for x in g) / len(g) for g, c in grams.items()})
    return sets


def weighted_jaccard(x, y):
    shared = sum(min(w, y[g]) for g, w in x.items() if g in y)
    total = sum(x.values()) + sum(y.values()) - shared
    return shared / total if total else 0.0


def near_pairs(rows, least=0.8):
    """Pairs of row numbers with unlike texts and a similarity of least or more; a pair shares its lighter row's rarest shingles or falls short."""
    sets, places = shingle_weights(rows), defaultdict(list)
    for k, x in enumerate(sets):
        for g in x:
            places[g].append(k)
    found = set()
    for k, x in enumerate(sets):
        left, near = sum(x.values()), set()
        for g, w in sorted(x.items(), key=lambda e: len(places[e[0]])):
            if left < least * sum(x.values()) - 1e-9:
                break  # what is left can't make up the similarity alone
            near.update(places[g])
            left -= w
        found |= {(min(k, j), max(k, j)) for j in near if rows[j] != rows[k] and weighted_jaccard(x, sets[j]) >= least}
    return found


def near_classes(rows, least=0.8):
    """By index of row, the smallest index it is linked with."""
    sets, parent = shingle_weights(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a] or "") == (rows[b] or "") or weighted_jaccard(sets[a], sets[b]) >= least:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


class Ctw:
    """Context-tree weighting with one dictionary of counts a decision and depth."""

    def __init__(self, depth, texts, others):
        self.depth, self.counts, self.nodes = depth, defaultdict(lambda: [0, 0]), set()
        for text, learn in [*((t, 1) for t in texts), *((t, 0) for t in others)]:
            for context, byte in self.steps(text):
                for d in range(depth + 1):
                    for k in range(8):
                        node = (k, context[depth - d :], (byte | 256) >> (8 - k))
                        self.nodes.add(node)
                        self.counts[node][byte >> (7 - k) & 1] += learn
        self.known = {}

    def steps(self, text):
        data = b"\xff" * self.depth + (text or "").encode() + b"\xff"
        return [(data[i - self.depth : i], data[i]) for i in range(self.depth, len(data))]

    def kt(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.known:
            k, context, bits = node
            if len(context) == self.depth:
                self.known[node] = self.kt(node)
            else:
                below = sum(self.weighted(child) for byte in range(256) if (child := (k, bytes([byte]) + context, bits)) in self.nodes)
                x, y = self.kt(node), below
                m = max(x, y)
                self.known[node] = m + math.log(math.exp(x - m) + math.exp(y - m)) - math.log(2)
        return self.known[node]

    def score(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for k in range(8):
                rest, p, bit = 1.0, 0.0, byte >> (7 - k) & 1
                for d in range(self.depth + 1):
                    node = (k, context[self.depth - d :], (byte | 256) >> (8 - k))
                    stop = 1.0 if d == self.depth else math.exp(self.kt(node) - math.log(2) - self.weighted(node))
                    c = self.counts[node]
                    p += rest * stop * (c[bit] + 0.5) / (c[0] + c[1] + 1)
                    rest *= 1 - stop
                total += math.log10(p)
        return total


def leaves(block):
    """The lines of nested lists, in order."""
    for x in block:
        if isinstance(x, tuple):
            yield x
        else:
            yield from leaves(x)


def main_lines(page, sigma, held, menu):
    """Main text of nested lists of ("p" or "a", text): plain ratios, smoothing, two-means and regions."""
    lines = list(leaves(page))
    if not lines:
        return []
    ratio = [math.log(1 + len(t) / (4 if kind == "a" else 2)) for kind, t in lines]
    reach, values = int(3 * sigma), []
    for i in range(len(lines)):
        near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), ratio[j]) for j in range(max(0, i - reach), min(len(lines), i + reach + 1))]
        values.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    low, high = min(values), max(values)
    for _ in range(50):
        under, over = [v for v in values if v < (low + high) / 2], [v for v in values if v >= (low + high) / 2]
        if not under or not over:
            break
        low, high = sum(under) / len(under), sum(over) / len(over)
    dense = [v >= (low + high) / 2 - 1e-12 for v in values]
    marked = iter(zip(lines, dense, strict=True))
    tree = (mark := lambda b: [next(marked) if isinstance(x, tuple) else mark(x) for x in b])(page)
    flat = lambda b: [y for x in b for y in ([x] if isinstance(x, tuple) else flat(x))]
    size = lambda b, test: sum(len(x[0][1]) for x in flat(b) if test(x))
    whole, region = size(tree, lambda x: x[1]), tree
    while True:
        inner = [x for x in region if isinstance(x, list) and size(x, lambda y: y[1]) >= held * whole]
        if not inner:
            break
        region = inner[0]

    def kept(b):
        for x in b:
            if isinstance(x, tuple):
                yield x[0][1]
            else:
                n = size(x, lambda y: True)
                if not (size(x, lambda y: y[1]) < menu[0] * n and size(x, lambda y: y[0][0] == "a") >= menu[1] * n):
                    yield from kept(x)

    return list(kept(region))


def toxic_matches(text, arcs, fixed, kinds, weight_of_fixed, reach):
    """Weights by kind of a text's clause matches, clause by clause with plain loops."""
    out = dict.fromkeys(kinds, 0.0)
    earlier = False
    for clause in re.split("[.!?;\n。！？；…]", text.lower()):
        target = agent = heard = quoted = False
        bare, waiting, threat, scope, number = True, 0.0, None, 0, 0
        for token in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]", clause):
            word = token.replace("’", "'")
            label, weight = ("quote", 0.0) if token in "\"“”„«»" else ("other", 0.0)
            for w in (word, word.split("'")[0]) if label != "quote" else ():
                arc = max([arcs.get("=" + w, 0.0), *(arcs.get("^" + w[:n], 0.0) for n in range(1, len(w) + 1))])
                label, weight = (fixed[w], weight_of_fixed) if w in fixed else ("insult", arc) if arc else ("other", 0.0)
                if label != "other":
                    break
            if label == "negation":
                scope, bare = reach, False
                continue
            negated, scope = scope > 0, max(0, scope - 1)
            if label == "quote":
                quoted, heard, bare = not quoted, False, False
            elif label == "report" and not (heard or quoted):
                heard, bare = True, False
            elif label == "insult" and (heard or quoted or negated):
                out["reported" if heard or quoted else "negated"] += weight
                bare = False
            elif label == "threat" and (heard or quoted or negated):
                out["softened"] += weight
                bare = False
            elif label == "insult" and target:
                out["targeted"] += weight
            elif label == "insult":
                waiting += weight
                number += 1
            else:
                bare = False
                if label == "threat" and agent and target:
                    out["threat"] += weight
                    threat = None
                elif label == "threat":
                    threat = weight
                elif label == "agent":
                    agent = True
                elif label == "target":
                    target = True
                    if threat:
                        out["threat"] += threat
                        threat = None
                    elif waiting:
                        out["targeted"] += waiting
                        waiting, number = 0.0, 0
        if number and not (target or bare):
            out["piled" if number > 1 else "tirade" if earlier else "loose"] += waiting
            earlier = True
        elif number:
            out["targeted"] += waiting
    return [out[k] for k in kinds]


def language_sums(text, names, p, mark, longest):
    """Logarithm of a text's probability in each language: each word's sum over all segmentations, letter by letter."""
    import regex

    found = regex.findall(r"\p{L}+", (text or "").lower())
    if not found:
        return None
    out, unknown = [0.0] * p.shape[1], p.shape[0] - 2
    for word in found:
        word = mark + word
        for lang in range(p.shape[1]):
            ahead, shift = [1.0] + [0.0] * len(word), 0.0
            for end in range(1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    k = names.get(word[start:end], unknown if end == start + 1 else None)
                    ahead[end] += ahead[start] * p[k, lang] if k is not None else 0.0
                if ahead[end] < 1e-100:  # keep the numbers in range
                    top = ahead[end]
                    ahead[max(0, end - longest) : end + 1] = [x / top for x in ahead[max(0, end - longest) : end + 1]]
                    shift += math.log(top)
            out[lang] += math.log(ahead[-1]) + shift
    return out


def fingerprints(corpus, texts, rules):
    """Fingerprints of texts by the lexicon of a corpus. rules: the operator's module, for its parameters."""
    import regex
    import xxhash

    def terms(text):
        return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", text.lower())))

    def hashed(value, seed=42, width=8):
        raw = value.encode() if isinstance(value, str) else (value % 2 ** (8 * width)).to_bytes(width, "little")
        found = xxhash.xxh64_intdigest(raw, seed % 2**64)
        return found - 2**64 if found >= 2**63 else found

    def chained(values):
        seed = 42
        for v in values:
            seed = hashed(v, seed)
        return seed

    counts = Counter(t for text in corpus for t in set(terms(text)))
    least, most = rules.COMMON[0] * len(corpus), max(2.0, rules.COMMON[1] * len(corpus))
    out = []
    for text in texts:
        found, subsets = terms(text), defaultdict(set)
        for t in found:
            h = hashed(t)
            mixed = hashed(1, hashed(h), 4)
            slot, part = mixed % rules.SLOTS, mixed >> 8
            if least <= counts[t] <= most:
                subsets[slot].add(h)
                if part % rules.RATES[2] == 0:
                    subsets[2 * rules.SLOTS + slot].add(h)
                if part % rules.RATES[1] == 0 or part % rules.RATES[2] == 0:
                    subsets[rules.SLOTS + slot].add(h)
            if len(found) <= rules.FEW and not (counts[t] > most and counts[t] >= least):
                subsets[3 * rules.SLOTS + slot].add(h)
        parts = sorted(f"{s:02x}" + f"{chained(sorted(x)) % 2**64:x}"[-rules.DIGITS :] for s, x in subsets.items())
        out.append(".".join(parts) if parts else f"zz{hashed(chained(found)) % 2**64:x}" if found else "")
    return out


def likeness(one, other, rules):
    if one == other:
        return 1.0
    best = 0.0
    a, b = ({p[:2]: p for p in x.split(".") if p and p[:2] != "zz"} for x in (one, other))
    for k in range(len(rules.RATES) + 1):
        used = {s for s in a.keys() | b.keys() if k * rules.SLOTS <= int(s, 16) < (k + 1) * rules.SLOTS}
        if len(used) >= (1 if k in (0, len(rules.RATES)) else rules.ENOUGH):
            best = max(best, sum(a.get(s) == b.get(s) for s in used) / len(used))
    return best
