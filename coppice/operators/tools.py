"""The engine's three tools (search, get, neighbors) with argument checks and a JSON envelope."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import hierarchy, vectors

VERSION = "2024-11-05"
NO_METHOD, FAILED = -32601, -32603


@dataclass
class Tools:
    """nodes: the node table; embeddings: ``id, embedding``; embed: text to a vector."""

    nodes: DataFrame
    embeddings: DataFrame
    embed: object

    def search(self, query: str, k: int = 10, type: str | None = None) -> DataFrame:  # noqa: A002
        if not query:
            raise ValueError("query is empty")
        return vectors.search(self.embeddings, self.nodes, vectors.unit(self.embed(query)), k, type)

    def get(self, id: str) -> DataFrame:  # noqa: A002
        found = hierarchy.project(self.nodes).join(hierarchy.get(self.nodes, id).select("id"), "id", "left_semi")
        if found.isEmpty():
            raise KeyError(f"no node {id}")
        return found

    def neighbors(self, id: str, window: int = 8) -> DataFrame:  # noqa: A002
        one = hierarchy.get(self.nodes, id).select("id")
        if one.isEmpty():
            raise KeyError(f"no node {id}")
        return hierarchy.neighbours(self.nodes, one, window)

    def handle(self, request: dict) -> dict:
        """One request of the line protocol: initialize, ping, tools/list or tools/call."""
        tools = {"search": self.search, "get": self.get, "neighbors": self.neighbors}
        method, params = request.get("method"), request.get("params") or {}
        answer = lambda **x: {"jsonrpc": "2.0", "id": request.get("id"), **x}
        if method == "initialize":
            return answer(result={"protocolVersion": VERSION, "capabilities": {"tools": {}}})
        if method == "ping":
            return answer(result={})
        if method == "tools/list":
            return answer(result={"tools": [{"name": n} for n in tools]})
        if method != "tools/call" or params.get("name") not in tools:
            return answer(error={"code": NO_METHOD, "message": f"unknown: {method if method != 'tools/call' else params.get('name')}"})
        try:
            return answer(result=envelope(tools[params["name"]](**(params.get("arguments") or {}))))
        except (KeyError, ValueError, TypeError) as e:
            return answer(result={"content": [{"type": "text", "text": str(e)}], "isError": True})
        except Exception as e:  # noqa: BLE001
            return answer(error={"code": FAILED, "message": str(e)})


def envelope(rows: DataFrame) -> dict:
    """A tool's bounded result as one text of JSON."""
    items = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect()]
    return {"content": [{"type": "text", "text": json.dumps(items, ensure_ascii=False)}]}
