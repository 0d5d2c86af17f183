"""Plain versions of the operators, for small tables: one row after the other, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    hit = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dups, "n_repeat_words": len(hit), "base_failed": len(words) < 20 or 100 * len(hit) > 30 * len(words)}


def suffix_dedup(rows, length=100):
    """rows: (doc_id, text) in order. Removes what starts earlier, byte by byte."""
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """prints: {id: fingerprint}; {id: smallest reachable id}."""
    ids, root = sorted(prints), {}
    for i in ids:
        if i in root:
            continue
        todo, root[i] = [i], i
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in root and (prints[a] ^ prints[b]).bit_count() <= radius:
                    root[b] = i
                    todo.append(b)
    return root


def op5_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(text, items):
    """items: [(item_id, text)]."""
    words, hit, found = op5_words(text), set(), set()
    for item, own in items:
        w = op5_words(own)
        for i in range(max(1, len(w) - 12) if w else 0):
            window = w[i : i + 13]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(item))
    return {"n_words": len(words), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit) and 20 * len(hit) >= len(words)}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def span_names(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone', 'term')[k]}:{a}:{z}" for a, k, z in spans)


def crc_of(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def prefix_maximal(convs):
    """convs: {id: [turn, ...]}; {id: copies} of those that no longer one extends, smallest id of equal ones."""
    out = {}
    for i, own in convs.items():
        if any(len(o) > len(own) and o[: len(own)] == own for o in convs.values()):
            continue
        same = [j for j, o in convs.items() if o == own]
        if i == min(same):
            out[i] = len(same)
    return out
