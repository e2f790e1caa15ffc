"""Workflows over JSON-RPC 2.0, a request and an answer a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import SparkSession

from .workflow import execute, list_workflows, load_workflow

#: Fixed values of the protocols.
PROTOCOL, NO_METHOD, FAILED = "2024-11-05", -32601, -32000


class Server:
    """``context`` makes the tables of a run out of its inputs; nothing else is needed to start a workflow."""

    def __init__(self, spark: SparkSession, context: Callable[[SparkSession, dict], dict[str, Any]] = lambda spark, inputs: dict(inputs)):
        self.spark, self.context, self.runs = spark, context, 0
        nothing = {"type": "object", "properties": {}}
        start = {"type": "object", "properties": {"workflow_name": {"type": "string"}, "inputs": {"type": "object"}}, "required": ["workflow_name"]}
        self.tools = {"workflow.list": ("Names of the workflows.", nothing, self.listed), "workflow.start": ("Runs a workflow.", start, self.started)}

    def listed(self, given: dict) -> dict:
        return {"workflows": list_workflows()}

    def started(self, given: dict) -> dict:
        name = str(given.get("workflow_name") or "")
        if not name:
            raise ValueError("workflow_name is missing")
        run = execute(self.spark, load_workflow(name), self.context(self.spark, given.get("inputs") or {}))
        self.runs += 1
        return {"run_id": f"run-{self.runs}", "workflow_name": name, "status": run.status, "phases": {k: p.status for k, p in run.phases.items()}}

    def called(self, params: dict) -> dict:
        name = str(params.get("name"))
        if name not in self.tools:
            raise ValueError(f"unknown tool {name}")
        found = self.tools[name][2](params.get("arguments") or {})
        return {"content": [{"type": "text", "text": json.dumps(found, indent=2)}]}

    def answer(self, request: Any) -> dict | None:
        """The answer to one request; None for a notification."""
        request = request if isinstance(request, dict) else {}
        method, out = str(request.get("method") or ""), {"jsonrpc": "2.0", "id": request.get("id")}
        if method.startswith("notifications/"):
            return None
        try:
            if method == "initialize":
                return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "convoscore", "version": "1"}}}
            if method == "tools/list":
                return out | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in self.tools.items()]}}
            if method == "tools/call":
                return out | {"result": self.called(request.get("params") or {})}
        except Exception as e:  # noqa: BLE001 - the caller gets to know, the server goes on
            return out | {"error": {"code": FAILED, "message": str(e)}}
        return out | {"error": {"code": NO_METHOD, "message": f"no method {method}"}}

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        """Answers until the input ends; lines that are no JSON are passed over."""
        for line in lines:
            try:
                said = self.answer(json.loads(line))
            except ValueError:
                continue
            if said is not None:
                out.write(json.dumps(said) + "\n")
                out.flush()
