"""Workspaces of several repositories: mount order by dependencies."""

from __future__ import annotations


def mount_order(names: list[str], needs: dict[str, list[str]]) -> list[str]:
    """Repositories so that each comes after those it needs.

    Among those that are ready the order is the declared one.  Members of
    cycles follow in declared order.  Unknown names in ``needs`` are ignored.
    """
    known = set(names)
    open_ = {n: {d for d in needs.get(n, ()) if d in known and d != n} for n in names}
    out: list[str] = []
    while open_:
        ready = [n for n in names if n in open_ and not open_[n] & open_.keys()]
        if not ready:
            return out + [n for n in names if n in open_]
        out.append(ready[0])
        del open_[ready[0]]
    return out


def mount_entries(repos: list[dict]) -> list[dict]:
    """``name, backing_path, at, writable`` of repositories (``name``, ``path``, optional ``at``, ``writable``)."""
    return [{"name": r["name"], "backing_path": r.get("path", ""), "at": r.get("at") or r["name"], "writable": bool(r.get("writable", False))} for r in repos]
