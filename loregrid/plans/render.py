"""Results as text, for people: each function takes a small table (already limited) or a dict and gives Markdown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def _rows(df: DataFrame, most: int) -> tuple[list, bool]:
    rows = df.limit(most + 1).collect()
    return rows[:most], len(rows) > most


def _said(r) -> str:
    return " ".join(r[c] for c in ("subject", "predicate", "value"))


def _section(title: str, lines: Iterable[str], more: bool = False, empty: str = "(none)") -> str:
    body = list(lines)
    return "\n".join([f"## {title}", "", *(body or [empty]), *(["..."] if more else [])])


def search_results(query: str, df: DataFrame, most: int = 20) -> str:
    rows, more = _rows(df, most)
    out = []
    for i, r in enumerate(rows, 1):
        out += [f"### {i}. {r['citation']['formatted']} (score {r['score']:.4f})", f"{r['module']} / {r['doc_type']}" + (f" / {r['heading_chain']}" if r["heading_chain"] else ""), "", r["highlight"]]
        context = r["context"] if "context" in df.columns else None
        for side in ("prev", "next"):
            out += [f"> {side}: {t}" for t in (context[side] if context else [])]
        out += [f"- rule {c['id']} ({c['status']}): {_said(c)}" for c in (r["canon_refs"] or [] if "canon_refs" in df.columns else [])]
        out.append("")
    return _section(f"Results for {query}", out, more)


def facts(title: str, df: DataFrame, most: int = 20) -> str:
    rows, more = _rows(df, most)
    return _section(title, (f"- [{r['type']}] {_said(r)} ({r['confidence']:.2f}; {r['source']})" for r in rows), more)


def modules(df: DataFrame, most: int = 1000) -> str:
    rows, more = _rows(df.orderBy("module"), most)
    return _section(f"{len(rows)} modules, {sum(r['n'] for r in rows)} documents", (f"- **{r['module']}** ({r['n']}): {', '.join(r['documents'])}" for r in rows), more)


def index_result(mode: str, report: dict) -> str:
    timing = report.get("timings", {})
    return _section(f"Index, {mode}", [*(f"- {k}: {v}" for k, v in report.items() if k not in ("timings", "errors")), *(f"- time, {k}: {v:.1f} s" for k, v in timing.items()), *(f"- failed: {p}: {e}" for p, e in report.get("errors", []))])


def cleanup(df: DataFrame, dry_run: bool, most: int = 20) -> str:
    rows, more = _rows(df.orderBy("path"), most)
    return _section("Would be removed" if dry_run else "Removed", (f"- {r['path']} ({r['status']}): {r['chunks']} chunks, {r['facts']} facts, {r['rules']} rules" for r in rows), more)


def rules(df: DataFrame, most: int = 100) -> str:
    rows, more = _rows(df.orderBy("module", "id"), most)
    return _section("Rules", (f"- {r['id']} [{r['status']}, {r['priority']}] {r['module']}: {_said(r)}" for r in rows), more)


def conflicts(df: DataFrame, most: int = 50) -> str:
    rows, more = _rows(df, most)
    out, last = [], None
    for r in rows:
        if r["category"] != last:
            last = r["category"]
            out.append(f"### {last}")
        out.append(f"- {r['old_id']} / {r['new_id']}: {r['old_subject']} {r['old_predicate']}: {r['old_value']} ({r['old_source']}) or {r['new_value']} ({r['new_source']})")
        for side in ("old", "new"):
            if f"{side}_context" in df.columns and r[f"{side}_context"]:
                out.append(f"  > {r[f'{side}_context']}")
    return _section("Conflicts", out, more)


def canon_status(counts: DataFrame, pairs: DataFrame, most: int = 10) -> str:
    rows = counts.orderBy("dimension", "name").limit(500).collect()
    shown, more = _rows(pairs, most)
    lines = [f"- {r['dimension']}{'' if r['name'] is None else ' ' + r['name']}: {r['n']}" for r in rows]
    return _section("Rule base", [*lines, *(f"- open: {r['old_id']}: {r['old_value']} or {r['new_value']}" for r in shown)], more)


def overview_stats(stats: dict) -> str:
    return _section("Statistics", (f"- {k}: {v}" for k, v in stats.items()))


def changes(df: DataFrame, most: int = 50) -> str:
    rows, more = _rows(df, most)
    return _section("Changes", (f"- {r['indexed_at']}: {r['path']}" for r in rows), more)


def gaps(counts: DataFrame, df: DataFrame, most: int = 8) -> str:
    head = " ".join(f"{r['status']} {r['n']};" for r in counts.collect())
    rows, more = _rows(df, most)
    return _section(f"State: {head.rstrip(';')}", (f"- {r['status']}: {r['src'] or r['dst']}" + (f" ({r['drift']})" if r["drift"] else "") for r in rows), more)


def relations(df: DataFrame, most: int = 200) -> str:
    rows, more = _rows(df.orderBy("from", "to"), most)
    return _section("Relations of modules", (f"- {r['from']} -> {r['to']} ({r['ref']})" for r in rows), more)


def related(module: str, df: DataFrame, most: int = 50) -> str:
    rows, more = _rows(df.orderBy("hops", "module"), most)
    out = []
    for r in rows:
        out.append(f"- {r['module']}, {r['hops']} steps away, {r['facts_count']} facts")
        out += [f"  - {_said(f)}" for f in r["key_facts"]]
    return _section(f"Around {module}", out, more)


def check(result: dict) -> str:
    out = [f"- status: {result['status']}"]
    for name in ("violations", "passed", "conflicts", "related"):
        if name in result:
            rows, more = _rows(result[name], 20)
            out += [f"### {name} ({len(rows)}{'+' if more else ''})", *("- " + ", ".join(f"{k} {v}" for k, v in r.asDict().items()) for r in rows)]
    return _section("Check", out)


def audit(df: DataFrame, most: int = 50) -> str:
    rows, more = _rows(df, most)
    return _section("Contradictions", ("- " + " ".join(r[:2]) + ": " + "; ".join(f"{s['value']} ({s['source']})" for s in r["statements"]) for r in rows), more)


def preview(path: str, counts: DataFrame, df: DataFrame, most: int = 50) -> str:
    kinds = ", ".join(f"{r['type']} {r['n']}" for r in counts.orderBy("type").collect())
    return facts(f"Facts in {path} ({kinds or 'none'})", df, most)


def draft(topic: str, guidance: str, results: str) -> str:
    return f"## Notes for {topic}\n\n{guidance}\n\n{results}"
