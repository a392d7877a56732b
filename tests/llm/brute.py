"""The contracts said once more in plain Python, for small inputs."""

import hashlib
import math
import re
import zlib

from retail_spark.llm import secrets
from retail_spark.llm.quality import BOILERPLATE


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def license_base(text):
    text = ascii_lower(text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return (
        len(words),
        len(found),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x for _, x in found})),
    )


def secret_base(text):
    text = text or ""
    spans = []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for order, (kind, pattern, ok) in enumerate(
        (
            ("assign", assign, lambda m: len(m[2]) >= 6),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
        )
    ):
        # (?i) of ASCII patterns would take the long s and the Kelvin sign too
        found = [m for m in re.finditer(pattern, text) if ok(m)]
        if order == 0:
            found = [m for m in re.finditer(pattern, text, re.ASCII) if ok(m)]
        spans += [(m.start(), order, m.end(), kind) for m in found]
    spans.sort()
    count = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*count, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))


def entropy_spans(text):
    """(kind, start, end) of the stretches that high-entropy windows cover, window by window."""
    out = []
    for m in re.finditer(secrets.CANDIDATE, text or ""):
        word = m[0]
        if not (re.search("[0-9]", word) and re.search("[A-Za-z]", word)) or re.search("|".join(secrets.ALLOWED_WORDS), word.lower()):
            continue
        kind = "entropy_hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", word) else "entropy_base64"
        cleared = [r.span() for r in re.finditer("|".join(secrets.ALLOWED_RUNS), word.lower())]
        spans = []
        for i in range(len(word) - secrets.WINDOW + 1):
            window = word[i : i + secrets.WINDOW]
            shares = [window.count(c) / len(window) for c in set(window)]
            if -sum(p * math.log2(p) for p in shares) < secrets.CLASSES[kind][1] - 1e-10:
                continue
            if any(a < i + len(window) and i < b for a, b in cleared):
                continue
            if spans and spans[-1][1] >= i:
                spans[-1][1] = i + len(window)
            else:
                spans.append([i, i + len(window)])
        out += [(kind, m.start() + a, m.start() + b) for a, b in spans]
    return out


def quality_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        dup,
        len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def line_dedup(rows):
    """rows: (doc_id, text) -> (doc_id, n_lines, n_dropped, sha256) of each."""
    space = " \t\n\x0b\x0c\r"
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip(space))
            if len(key) >= 20:
                holders.setdefault(key, set()).add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            docs = holders.get(ascii_lower(line.strip(space)), ())
            if not (len(docs) >= 3 and (-(2**63) if doc is None else doc) != max(docs)):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def words5(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if len(words) < 5:
        return {tuple(words): 1} if words else {}
    out = {}
    for i in range(len(words) - 4):
        out[tuple(words[i : i + 5])] = out.get(tuple(words[i : i + 5]), 0) + 1
    return out


def near_classes(rows):
    """rows: (doc_id, text), ids distinct -> {doc_id: smallest id of its group}."""
    counts = {d: words5(t) for d, t in rows}
    df = {}
    for c in counts.values():
        for x in c:
            df[x] = df.get(x, 0) + 1
    n = len(rows)
    idf = {x: min(1.0, math.log((n + 1) / k) / math.log(3)) for x, k in df.items()}
    weights = {d: {x: (1 + math.log(k)) * idf[x] for x, k in c.items()} for d, c in counts.items()}
    group = {d: d for d in counts}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    docs = sorted(counts)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            x, y = weights[a], weights[b]
            if not x or not y:
                alike = not x and not y
            else:
                least = sum(min(w, y[k]) for k, w in x.items() if k in y)
                alike = least >= 0.8 * (sum(x.values()) + sum(y.values()) - least)
            if alike:
                a_, b_ = root(a), root(b)
                group[max(a_, b_)] = min(a_, b_)
    return {d: root(d) for d in docs}


def shared_windows(rows, n=50):
    """{doc_id: places where n words begin that an earlier document holds too}."""
    first, found = {}, {}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or "")) for d, t in rows}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - n + 1):
            if first.setdefault(tuple(w[i : i + n]), d) != d:
                found.setdefault(d, []).append(i)
    return found


def lm_base(rows):
    """rows: (doc_id, text) -> [(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)]."""
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or "")) + [None] for _, t in rows]
    counts = {}
    for (d, _), own in zip(rows, tokens, strict=True):
        if not held(d):
            for x in own:
                counts[x] = counts.get(x, 0) + 1
    total = sum(counts.values())
    return [
        (
            d, held(d), len(own), sum(x in counts for x in own), total,
            sum(math.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in own),
        )
        for (d, _), own in zip(rows, tokens, strict=True)
    ]


def line_fails(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n = len(words)
    if not n:
        return False
    marked = sum(bool(re.search(r"(?:[#*$%&|<>]|[!?][!?])$", w)) for w in words)
    bars = sum(w in tuple("|»›><·•/") for w in words)
    phrase = any(p in line.lower() for phrases in BOILERPLATE.values() for p in phrases)
    leads_on = line.rstrip(" \t\n\x0b\x0c\r").endswith(("...", *"…»›>→|·•"))
    closed = any(c in line for c in ".!?…:;")
    return (
        marked > 0.3 * n
        or bars > 0.15 * n
        or (n >= 10 and len(set(words)) < min(0.2 * n, n**0.73))
        or (n <= 25 and (phrase or leads_on))
        or ((len(line) > 1500 or n > 60) and not closed)
    )


def cleaned(text):
    """The text without failing lines, or None if the document is refused."""
    if quality_base(text)[5]:
        return None
    kept = "\n".join(x for x in (text or "").split("\n") if not line_fails(x))
    size = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t))
    return kept if size(kept) >= 0.5 * size(text) else None
