"""Plain Python forms of the operators, for small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONTENT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, host string, key string, score string, matches string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(seed=7, n=90):
    """(rows in SCHEMA): nulls, empties, copies, near copies, passages, personal data, clashing extra columns."""
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(["a", "of", "The", "thé", "日本", "x" * r.randint(1, 9) + str(r.randint(0, 400))]) for _ in range(k))
    passage, line = say(70), "Share this page now with all"
    texts = [None, "", "   \n\t ", "one", "Two words", "1234 !!", say(4), say(9000)]
    base = [say(r.randint(20, 120)) for _ in range(8)]
    for i in range(n - len(texts)):
        k = i % 9
        t = r.choice(base) if k < 2 else say(r.randint(3, 160))
        if k == 2:
            words = r.choice(base).split(" ")
            words[r.randrange(len(words))] = "edit" + str(i)
            t = " ".join(words)
        if k == 3:
            t = say(r.randint(0, 30)) + " " + passage + "\n" + say(r.randint(0, 30))
        if k == 4:
            t = line + "\n" + t + "\n\n" + line
        if k == 5:
            t += f" mail me{i}@host-{i}.example.com or 10.0.{i}.256 10.0.0.{i}.7 card 4111 1111-1111 1111 tel +1 (555) 010-{1000 + i} end"
        if k == 6:
            t = (say(6) + " ") * 9
        texts.append(t)
    rows = [(i * 3, t, r.choice(["en", "fr", None]), r.choice(["s1", "s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[20])
    rows.append((None, rows[15][1], "en", "s1", 1))
    return [(*x, "row", "size", "host", "key", "score", "matches") for x in rows]


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def components(rows):
    """doc_id -> smallest id that links reach; texts of null ids link too, and texts of one id are one document."""
    sets = [(("id", d) if d is not None else ("row", i), shingles(t)) for i, (d, t, *_) in enumerate(rows)]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {d: find(("id", d))[1] for kind, d in root if kind == "id"}


def groups(rows):
    """Indexes of linked rows, set by set; rows without a word are alone."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return list(out.values())


def rules(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def decontaminated(text, benchmark):
    windows = defaultdict(set)
    for item, t in benchmark:
        w = CONTENT.findall(lower(t)) if item is not None else []
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    w, hit, items = CONTENT.findall(lower(text)), set(), set()
    for k in {len(x) for x in windows}:
        for i in range(len(w) - k + 1):
            if found := windows.get(tuple(w[i : i + k])):
                hit |= set(range(i, i + k))
                items |= found
    return len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def held(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def personal(text):
    out, counts = [], []
    for kind, pattern in PII.items():
        found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if held(kind, m[0])]
        out += found
        counts.append(len(found))
    return (*counts, sha(",".join(out)))


def telling(rows, near=40, prior=2, least=0.85):
    """term -> replacement, from the texts of all rows."""
    texts = {t or "" for _, t, *_ in rows}
    any_kind = re.compile("|".join([rf"(?P<email>{PII['email']})", rf"(?P<ip>(?<![0-9]){PII['ip']})", rf"(?P<phone>{PII['phone']})", r"(?P<card>[0-9](?:[\x20-]?[0-9]){12,})"]))
    said = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{2,}", t)}
    names = lambda ws: {"=" + w for w in ws} | {"3" + w[:3] for w in ws if len(w) > 3} | {"1" + w[0] for w in ws}
    total, target, pair, beside = Counter(), defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        total.update(names(said(t)))
        found, last = list(any_kind.finditer(t)), 0
        for i, m in enumerate(found):
            until = found[i + 1].start() if i + 1 < len(found) else len(t)
            kind = m.lastgroup if m.lastgroup in PII else next(k for k in PII if m[k])
            left, right = t[last : m.start()], t[m.end() : until]
            last = m.end()
            if not held(kind, m[0]):
                continue
            left = re.sub(r"^[^\W\d_]+", "", left[-near - 1 :]) if len(left) > near else left
            right = re.sub(r"[^\W\d_]+$", "", right[: near + 1]) if len(right) > near else right
            words = said(left + " " + right)
            for c in ((kind, m[0]), (kind, None)):
                target[c].add(t)
                for name in names(words):
                    pair[c, name].add(t)
            for w in words:
                beside[w].add(t)
    most = defaultdict(lambda: -9.0)
    for (c, name), where in pair.items():
        p = len(target[c]) / len(texts)
        given = (len(where) + prior * p) / (total[name] + prior)
        bits = -math.log2(p)
        most[name] = max(most[name], math.log2(given / p) / bits if bits > 0 else 0.0)
    safe = lambda name: name in most and most[name] < least
    out = {}
    for name, d in most.items():
        if name[0] == "=" and d >= least:
            w = name[1:]
            three, one = "3" + w[:3], "1" + w[0]
            out[w] = f"<{w[:3]}*>" if len(w) > 3 and safe(three) else f"<{w[0]}*>" if safe(one) else ""
    return out


def term_spans(text, instead):
    """(start, end, replacement) of telling terms outside addresses."""
    hidden = re.sub(PII["email"], lambda m: " " * len(m[0]), text or "")
    return [(m.start(), m.end(), instead[m[0].lower()]) for m in re.finditer(r"[^\W\d_]{2,}", hidden) if m[0].lower() in instead]


def substrings(rows, width=50):
    """Index of the row -> (words, removed, sha of what is kept)."""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - width + 1) if d is not None and first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def boilerplate(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, t, _, s, *_ in rows:
        pages[s] += 1
        seen.update({(s, x) for x in (t or "").split("\n") if WORD.search(x)})
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad) for _, t, _, s, *_ in rows]


def targets(sizes):
    """source -> target words; sizes: source (None last) -> words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / (sum(weight[s] for s in names if s not in capped) or 1)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over
