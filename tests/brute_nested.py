"""Plain reading of the three kinds of record, row by row, to test the nested operator against."""

import json


def load(body):
    if body is None:
        return None
    s = body.strip("﻿ \t\r\n")
    tries = [s]
    for i, ch in enumerate(s):
        if ch in '[{"' and (i == 0 or s[:i].rstrip(" \t﻿").endswith("\n")):
            tries.append(s[i:])
            break
    for t in tries:
        try:
            v, _ = json.JSONDecoder().raw_decode(t)
        except ValueError:
            continue
        for _ in range(2):
            if isinstance(v, str):
                v = load(v)
        return v if isinstance(v, (dict, list)) else None
    return None


def items(x):
    if x is None:
        return []
    return [(i, e) for i, e in enumerate(x) if e is not None] if isinstance(x, list) else [(0, x)]


def found(rows):
    out = set()
    for rid, kind, body in rows:
        v = load(body)
        if v is None:
            continue
        if kind == "report":
            r = v.get("report", v)
            for _, c in items(r.get("test_case_candidates")):
                for pos, e in items(c.get("evidence")):
                    e = e.get("symbol") or e.get("edge") or e
                    out.add((rid, "evidence", c.get("id"), pos, e.get("qualified_name") or e["from_symbol"]["qualified_name"], c.get("id")))
        elif kind == "pilot":
            for k, p in items(v):
                for pos, h in items(p.get("hits")):
                    s = h["symbol"]
                    out.add((rid, "hit", p.get("intro"), pos, s if isinstance(s, str) else f"{s['file_path']}:{s['function']}", k))
        else:
            for pos, x in items(v.get("additional_checks")):
                e = x.get("evidence")
                e = e[0] if isinstance(e, list) and e else e
                if e:
                    out.add((rid, "check", "additional_checks", pos, e if isinstance(e, str) else f"{e['file_path']}:{e['line']}", 0))
    return sorted(x[:5] for x in out)
