"""Remote stores behind a queue that outlives the process, and child processes with bounded output."""

from __future__ import annotations

import base64
import json
import os
import signal
import subprocess
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any, Protocol

from ..functions.redaction import names_secret
from ..operators.nested import redact_tree
from .files import Files


class Transport(Protocol):
    """What a remote store has to offer."""

    def put(self, key: str, payload: bytes) -> Any: ...

    def get(self, key: str) -> bytes: ...

    def delete(self, key: str) -> Any: ...


def checked_key(key: str) -> str:
    """A relative key with forward slashes and without empty, . or .. steps."""
    plain = key.replace("\\", "/")
    if not key.strip() or "\0" in key or any(step in ("", ".", "..") for step in plain.split("/")):
        raise ValueError("a key is a relative path without empty, . or .. steps")
    return plain


class Remote:
    """Puts, gets and deletes by a transport; without one they wait in a folder, in order, one file each.

    A flush applies what waits in the order it came. A key whose operation fails keeps its later ones waiting, others
    go on; what was applied is gone from the folder. `audit` is told of each action, without payloads or secrets.
    """

    def __init__(self, queue: Files, transport: Transport | None = None, audit: Callable[[dict[str, Any]], Any] | None = None):
        self.queue, self.transport, self.audit = queue, transport, audit

    def _tell(self, action: str, key: str, **details: Any) -> None:
        if self.audit:
            self.audit(redact_tree({"action": action, "key": key, "at": time.time(), **details}))

    def _wait(self, action: str, key: str, payload: bytes | None = None) -> str:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        body = {"action": action, "key": key, "payload": None if payload is None else base64.b64encode(payload).decode()}
        self.queue.write(f".{name}", json.dumps(body).encode())
        self.queue.rename(f".{name}", name)  # there whole or not at all
        self._tell(f"queued_{action}", key)
        return name

    def put(self, key: str, payload: bytes) -> Any:
        key = checked_key(key)
        if self.transport is None:
            return self._wait("put", key, bytes(payload))
        self._tell("put", key, size=len(payload))
        return self.transport.put(key, bytes(payload))

    def delete(self, key: str) -> Any:
        key = checked_key(key)
        if self.transport is None:
            return self._wait("delete", key)
        self._tell("delete", key)
        return self.transport.delete(key)

    def get(self, key: str) -> bytes:
        if self.transport is None:
            raise RuntimeError("there is no transport to read by")
        self._tell("get", checked_key(key))
        return self.transport.get(checked_key(key))

    def waiting(self) -> list[str]:
        return [n for n in self.queue.names() if not n.startswith(".")]

    def flush(self, at_most: int | None = None) -> list[tuple[str, str, str]]:
        """(action, key, state) of what was waiting: applied, failed or blocked."""
        if self.transport is None:
            raise RuntimeError("there is no transport to flush to")
        out, stuck = [], set()
        for name in self.waiting()[:at_most]:
            op = json.loads(self.queue.read(name))
            state = "blocked" if op["key"] in stuck else "applied"
            if state == "applied":
                try:
                    if op["action"] == "put":
                        self.transport.put(op["key"], base64.b64decode(op["payload"]))
                    else:
                        self.transport.delete(op["key"])
                    self.queue.delete(name)
                except Exception:  # a transport may fail in any way; the operation stays where it is
                    state = "failed"
                    stuck.add(op["key"])
            self._tell(f"flush_{op['action']}", op["key"], state=state)
            out.append((op["action"], op["key"], state))
        return out


def execute(command: Sequence[str], timeout: float | None = None, max_output: int = 100_000, cwd: str | None = None, extra_env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Run a child process on the driver: exit code, the last max_output characters of each output, seconds, and whether
    it was stopped. At the timeout its whole process group is ended. Values of variables named like secrets don't show."""
    began = time.monotonic()
    child = subprocess.Popen(list(command), cwd=cwd, env={**os.environ, **(extra_env or {})}, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", start_new_session=True)
    stopped = False
    try:
        out, err = child.communicate(timeout=timeout)
    except subprocess.TimeoutExpired:
        stopped = True
        os.killpg(child.pid, signal.SIGKILL)
        out, err = child.communicate()
    hidden = [v for k, v in (extra_env or {}).items() if names_secret(k) and v]

    def shown(text: str) -> str:
        for value in hidden:
            text = text.replace(value, "<redacted>")
        return text[-max_output:]

    return {"exit_code": child.returncode, "stdout": shown(out), "stderr": shown(err), "cut": max(len(out), len(err)) > max_output, "stopped": stopped, "seconds": time.monotonic() - began}
