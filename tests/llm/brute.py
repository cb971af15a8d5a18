"""Plain versions of the operators, for tables of a few hundred rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def base_places(text):
    w, out = words(text), []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(out), min((i for i, _ in out), default=None), max((i for i, _ in out), default=None), ",".join(sorted({x for _, x in out}))


def decontaminate(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids).encode()), bool(hit)))
    return out


def repeated_words(docs, width=50):
    cut = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in docs]
    least = {}
    for doc, w in cut:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if doc is not None and (key not in least or doc < least[key]):
                least[key] = doc
    out = []
    for doc, w in cut:
        gone = set()
        for i in range(len(w) - width + 1):
            if doc is not None and least[tuple(w[i : i + width])] < doc:
                gone |= set(range(i, i + width))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def repeated_bytes(docs, width=200):
    raw = [(doc, (text or "").encode()) for doc, text in docs]
    seen = Counter(b[i : i + width] for _, b in raw for i in range(len(b) - width + 1))
    out = []
    for doc, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs):
    return [row[:3] for row in near_groups(docs)]


def near_groups(docs):
    """doc_id, fingerprint, component_id and a number of the component."""
    fps = [(doc, simhash(text)) for doc, text in docs]
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(doc, f"{fp:016x}", least.get(find(i)), find(i)) for i, (doc, fp) in enumerate(fps)]


def pieces(tokenizer, docs, size=2048):
    import numpy as np

    out = {}
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            out[doc, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def one_edit(a, b):
    """Whether b, as long as a or one longer, is a with one letter changed or added."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def spelling_variants(docs, slip=31, min_letters=7, min_count=2, ratio=10):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        if len(w) > 100:
            near[w] = [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and one_edit(*sorted((x, w), key=len))]
            continue
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = [e for e in edits - {w} if e in words]
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def align(docs, a, b):
    """docs' counts and groups, by comparing offsets; a and b are the two tokenizers."""
    letters = {**{chr(x): x for x in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in letters)}
    parts, holds = [], Counter()
    for doc, text in docs:
        raw = f" {text}".encode()
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        if b"".join(xb) != raw or b"".join(yb) != raw:
            parts.append((doc, [], [], []))
            continue
        xe, ye = [list(np.cumsum([len(t) for t in ts])) for ts in (xb, yb)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(xe) & set(ye)):
            k, m = xe.index(cut, i) + 1, ye.index(cut, j) + 1
            groups.append((x[i:k], y[j:m]))
            i, j = k, m
        holds.update({(p, q) for g in groups for p in g[0] for q in g[1]})
        parts.append((doc, x, y, groups))
    top = defaultdict(int)
    for (p, _), n in holds.items():
        top[p] = max(top[p], n)
    out = []
    for doc, x, y, groups in parts:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        out.append((doc, len(x), len(y), len(groups), len(links), sum(holds[z] == top[z[0]] for z in links), sum(holds[z] for z in links), sha(text.encode()) if groups else ""))
    return out


def line_dedup(docs, min_docs=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    holds = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holds[key(line)].add(("text", text or "") if doc is None else doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holds[key(x)]) < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out
