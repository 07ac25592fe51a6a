"""A client for models behind an HTTP interface that takes and gives JSON, and the compact context that a proposal model reads."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Sequence

from sievewright.plans.search import ACTIONS, FIELDS, Node, Theta, Tree, bounds


class TimedOut(RuntimeError):
    """All attempts ran out of time."""


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 60.0, attempts: int = 3, pause: float = 1.0) -> dict:
    """The answer to ``body``; only timeouts are tried again, every other failure is raised at once."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}), method="POST")
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except TimeoutError:
            pass
        except urllib.error.URLError as e:
            if not isinstance(e.reason, TimeoutError):
                raise
        if attempt + 1 < attempts:
            time.sleep(pause * 2**attempt)
    raise TimedOut(f"{url}: no answer within {attempts} attempts of {timeout} s")


def json_in(text: str) -> dict:
    """The first JSON object in a model's answer, whatever stands around it; ValueError without one."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            return found
        except json.JSONDecodeError:
            at = text.find("{", at + 1)
    raise ValueError("the answer has no JSON object")


def context(node: Node, tree: Tree, columns: Sequence[str], target: str, archive: Sequence[Node] = (), references: int = 4) -> str:
    """What a model needs to propose the next scopes, as one line of JSON: columns, sizes, the node, a few others, the edits."""
    features = [c for c in columns if c != target]
    brief = lambda n: {"id": n.id, "theta": n.theta.as_dict() if n.theta else None, "reward": round(n.q_self, 4), "visits": n.n}
    beside = [tree.nodes[c] for c in tree.nodes[node.parent].children if c != node.id] if node.parent else []
    best = sorted((n for n in archive if n.id != node.id and n not in beside), key=lambda n: (-n.q_self, n.id))
    out = {
        "columns": {"features": features, "target": target}, "sizes": bounds(len(features)), "node": brief(node), "weak": node.info.get("weak", [])[:5],
        "siblings": [brief(n) for n in beside[:references]], "archive": [brief(n) for n in best[:references]], "actions": sorted(ACTIONS),
    }
    return json.dumps(out, sort_keys=True, separators=(",", ":"))


def proposals_from(answer: dict) -> list[Theta]:
    """The scopes of an answer {"proposals": [{col_1ds, col_2ds, col_ps, col_u}]}, the first of equal ones."""
    made = [Theta.make(*(p[f] for f in FIELDS), p["col_u"]) for p in answer.get("proposals", [])]
    return list({t.id: t for t in reversed(made)}.values())[::-1]
