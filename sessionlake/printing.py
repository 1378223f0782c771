"""Text output of the commands: plain lines, one block per result."""

from __future__ import annotations

SUMMARY, MESSAGE = 220, 1000  #: code points shown


def _flat(text: str | None, most: int) -> str:
    flat = " ".join((text or "").replace("<mark>", "").replace("</mark>", "").split())
    return flat[:most] + "…" if len(flat) > most else flat


def _named(pairs: list[tuple[str, object]]) -> list[str]:
    width = max(len(k) for k, _ in pairs) + 1
    return [f"{k + ':':<{width}} {'-' if v is None else v}" for k, v in pairs]


def sync(x: dict) -> list[str]:
    covered = "written" if x["coverage_written"] else f"not written ({x['reason'] or 'unknown'})"
    return ["sync", *_named([(k, x[k]) for k in ("scanned", "added", "updated", "skipped", "filtered", "removed", "errors")] + [("coverage", covered)])]


def find(x: dict) -> list[str]:
    out = [f'find "{x["query"]}"']
    if not x["results"]:
        return [*out, "no results"]
    for r in x["results"]:
        place = "session-level" if r["match_seq"] is None else f"seq={r['match_seq']}"
        out += ["", f"[{r['rank']}] {r['title'] or '(no title)'}", f"{r['started_at']} · {r['cwd'] or '-'}", f"uuid={r['session_uuid']} · {place} · matches={r['hits']}"]
        out += [_flat(r["summary_text"], SUMMARY)] if r.get("summary_text") else []
        out += [_flat(r["snippet"], MESSAGE)]
        out += [f"next: read-page {r['session_uuid']} --offset 0 --limit 40" if r["match_seq"] is None else f"next: read-range {r['session_uuid']} --seq {r['match_seq']}"]
    return out


def _said(m: dict) -> str:
    return f"[{m['seq']}] {'U' if m['role'] == 'user' else 'A'} {_flat(m['content_text'], MESSAGE)}"


def read_range(x: dict) -> list[str]:
    s = x["session"]
    out = [f"read-range {s['session_uuid']}", f"{s['title'] or '(no title)'} · {s['cwd'] or '-'}", f"anchor={x['anchor']} · range={x['from']}-{x['to']}", ""]
    return out + [f"{'>>' if m['seq'] == x['anchor'] else '  '} {_said(m)}" for m in x["messages"]]


def read_page(x: dict) -> list[str]:
    s = x["session"]
    out = [f"read-page {s['session_uuid']}", f"{s['title'] or '(no title)'} · total={x['total_count']} · offset={x['offset']} · limit={x['limit']} · more={str(x['has_more']).lower()}", ""]
    return out + [_said(m) for m in x["messages"]]


def sessions(x: dict) -> list[str]:
    out = ["list"]
    for i, s in enumerate(x["sessions"], 1):
        out += ["", f"[{i}] {s['title'] or '(no title)'}", f"{s['ended_at']} · {s['cwd'] or '-'} · msgs={s['message_count']}", f"uuid={s['session_uuid']}"]
        out += [_flat(s["summary_text"], SUMMARY)] if s.get("summary_text") else []
    return out if x["sessions"] else [*out, "no sessions"]


def stats(x: dict) -> list[str]:
    out = ["stats", *_named([
        ("sessions", x["session_count"]), ("messages", x["message_count"]), ("earliest", x["earliest"]), ("latest", x["latest"]), ("last_sync_at", x["last_sync_at"]),
        ("index_version", x["index_version"]), ("index", x["index"]), ("size_bytes", x["size_bytes"]), ("coverage_count", len(x["coverage"])),
    ])]
    if x["top_cwds"]:
        width = max(len(r["cwd"]) for r in x["top_cwds"])
        out += ["", "top cwds", *(f"  {r['cwd']:<{width}}  {r['n']}" for r in x["top_cwds"])]
    return out


def status(x: dict) -> list[str]:
    seen, index = x["inventory"], x["index"]
    pairs = [
        ("root", x["root"]), ("source_files", seen["file_count"]), ("source_dates", f"{seen['from_date'] or '-'}..{seen['to_date'] or '-'}"), ("index_exists", str(index["exists"]).lower()),
        ("sessions", index.get("session_count", 0)), ("messages", index.get("message_count", 0)), ("coverage_count", len(x["coverage"])),
    ]
    if "requested" in x:
        pairs += [("requested_coverage", x["requested"]["state"]), ("recommended_action", x["requested"]["recommended_action"])]
    out = ["status", *_named(pairs)]
    return out + (["", "source cwd groups", *(f"  {g['n']:>4}  {g['cwd']}" for g in seen["cwds"][:10])] if seen["cwds"] else [])


BY_COMMAND = {"sync": sync, "find": find, "read-range": read_range, "read-page": read_page, "list": sessions, "stats": stats, "status": status}
