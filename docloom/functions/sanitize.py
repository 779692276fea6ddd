"""Unicode abuse: oversized clusters, stacked marks, joiner chains, bidirectional and tag controls."""

from __future__ import annotations

import unicodedata

import regex

MAX_MARKS, MAX_CLUSTER, MAX_JOINED = 15, 16, 11
_BIDI = frozenset([*range(0x202A, 0x202F), *range(0x2066, 0x206A)])
_CLUSTER = regex.compile(r"\X")
REPORT = "text string, max_cluster int, excessive_marks int, zwj_chain int, bidi boolean, tags boolean, abuse boolean"


def _selector(c: int) -> bool:
    return 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF


def _flag(cluster: str) -> bool:
    """A black flag, one to eight tag letters or digits, and the closing tag."""
    body = [ord(c) for c in cluster]
    tags = body[1:-1]
    return len(body) > 2 and body[0] == 0x1F3F4 and body[-1] == 0xE007F and 1 <= len(tags) <= 8 and all(0xE0030 <= t <= 0xE0039 or 0xE0061 <= t <= 0xE007A for t in tags)


def sanitize(text: str | None) -> dict:
    """The cleaned text (NFC) and what was found; null stays null."""
    out = {"text": None, "max_cluster": 0, "excessive_marks": 0, "zwj_chain": 0, "bidi": False, "tags": False, "abuse": False}
    if text is None:
        return out
    parts = []
    for m in _CLUSTER.finditer(text):
        cluster = m[0]
        if len(cluster) == 1 and cluster < "\u0300":
            parts.append(cluster)
            out["max_cluster"] = max(out["max_cluster"], 1)
            continue
        out["max_cluster"] = max(out["max_cluster"], len(cluster))
        if "\u200d" in cluster:
            out["zwj_chain"] = max(out["zwj_chain"], len(cluster))
        flag, kept, marks, plain = _flag(cluster), [], 0, 0
        trimmed = False
        for ch in cluster:
            c = ord(ch)
            if c in _BIDI:
                out["bidi"] = True
                continue
            if 0xE0001 <= c <= 0xE007F and not flag:
                out["tags"] = True
                continue
            if _selector(c) and (not kept or _selector(ord(kept[-1]))):
                continue
            if ch == "\u200d" and plain >= MAX_JOINED:
                break
            if unicodedata.category(ch)[0] == "M" and not _selector(c):
                marks += 1
                if marks > MAX_MARKS:
                    trimmed = True
                    continue
            plain += ch != "\u200d"
            kept.append(ch)
        out["excessive_marks"] += (marks > 5) + trimmed
        parts.append("".join(kept[:MAX_CLUSTER]))
    cleaned = unicodedata.normalize("NFC", "".join(parts))
    out["text"] = cleaned
    out["abuse"] = out["max_cluster"] > 50 or out["excessive_marks"] > 0 or out["zwj_chain"] > 11 or out["bidi"] or out["tags"]
    return out


#: Texts without these are their own clusters, one character each, and stay as they are.
SUSPECT = r"[^\x{0000}-\x{02FF}]|\r"


def sanitized(docs, *, key: str = "doc_id", text: str = "text"):
    """(key, REPORT, _error) of a DataFrame of texts; only texts with marks, controls or wide characters go to Python."""
    from pyspark.sql import functions as F

    from docloom.plans.rowwise import rowwise

    suspect = F.coalesce(F.col(text).rlike(SUSPECT), F.lit(True))
    done = rowwise(docs.where(suspect), sanitize, [text], REPORT, [key])
    zero, no = F.lit(0), F.lit(False)
    plain = docs.where(~suspect).select(
        key, F.col(text).alias("text"), F.when(F.col(text) == "", 0).otherwise(1).alias("max_cluster"), zero.alias("excessive_marks"), zero.alias("zwj_chain"), no.alias("bidi"), no.alias("tags"), no.alias("abuse"), F.lit(None).cast("string").alias("_error")
    )
    return done.unionByName(plain)
