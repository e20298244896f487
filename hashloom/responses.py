"""Bodies of the control API's responses, as JSON text; a web server can hand them out as they are."""

from __future__ import annotations

import json

from hashloom.engine import Engine


def health(engine: Engine) -> str:
    return json.dumps(engine.health())


def runs(engine: Engine) -> str:
    """[{"id": .., "timestamp": ..}, ...] by id; a row a run."""
    return json.dumps([{"id": r["id"], "timestamp": r["timestamp"]} for r in engine.runs().select("id", "timestamp").orderBy("id").collect()])


def hashing_methods(engine: Engine) -> str:
    """Names of the registered methods, in their order."""
    return json.dumps([m.name for m in engine.methods])


def modifications(engine: Engine) -> str:
    return json.dumps([m.name for m in engine.modifications])


def run_hashing_methods(engine: Engine) -> str:
    """Ids selected for the next run."""
    return json.dumps(engine.selected_methods)


def run_modifications(engine: Engine) -> str:
    return json.dumps(engine.selected_modifications)


def submitted(result: dict[str, int]) -> str:
    """{"saved": .., "skipped": ..} of an upload."""
    return json.dumps(result)


def error(e: Exception) -> str:
    """{"error": kind, "message": text}."""
    return json.dumps({"error": type(e).__name__, "message": str(e)})


def start_run(engine: Engine, body: str) -> str:
    """Starts a run from {"path": .., "hashing_methods": [..], "modifications": [..]}; {"run_id": ..}, or the error."""
    try:
        config = json.loads(body)
        return json.dumps({"run_id": engine.start_run(config["path"], config["hashing_methods"], config["modifications"])})
    except Exception as e:  # noqa: BLE001 - whatever went wrong is the answer
        return error(e)
