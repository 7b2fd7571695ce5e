"""Reading a log while its writer appends: by place, across rotation, whole lines only.

This is for the one host that the writer's files lie on; files that appear whole are the
streaming query's in ``shipper``. A state is a plain dictionary to be stored after the
lines were shipped: if it is not, they come again, which the store's ids make harmless.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from pathlib import Path

#: Lines and bytes of a batch.
LINES, BYTES = 500, 8 << 20
START = {"inode": None, "offset": 0, "lost_files": 0, "bad_reads": 0}


def _files(path: str) -> list[Path]:
    """The log and what was rotated away (path.1 is the newest of those), oldest first."""
    log = Path(path)
    rotated = sorted((p for p in log.parent.glob(f"{log.name}.*") if p.suffix[1:].isdigit()), key=lambda p: -int(p.suffix[1:]))
    return [p for p in [*rotated, log] if p.exists()]


def at_end(path: str) -> dict:
    """The state of a reader that starts after all that is there."""
    files = _files(path)
    return {**START, "inode": files[-1].stat().st_ino, "offset": files[-1].stat().st_size} if files else dict(START)


def read(path: str, state: dict, lines: int = LINES, size: int = BYTES) -> tuple[list[str], dict]:
    """The next whole lines and the state after them; no lines if there are none yet.

    The file that was read last is known by its inode, wherever it was rotated to, and is
    finished before the next newer one. If it is gone, that is counted and the oldest one
    comes next; a file shorter than the place in it was cut and is read from its start. A
    line without an end waits, unless its file was rotated away and can't grow any more.
    """
    state = {**START, **state}
    files = _files(path)
    if not files:
        return [], state
    inodes = [p.stat().st_ino for p in files]
    if state["inode"] not in inodes:
        state |= {"lost_files": state["lost_files"] + (state["inode"] is not None), "inode": inodes[0], "offset": 0}
    k = inodes.index(state["inode"])
    while True:
        if state["offset"] > files[k].stat().st_size:
            state["offset"] = 0
        with open(files[k], "rb") as f:
            f.seek(state["offset"])
            data = f.read(size)
            more = len(data) == size
            while more and b"\n" not in data and (rest := f.read(size)):  # one line larger than a batch
                data += rest
        closed = k < len(files) - 1
        if closed and data and not data.endswith(b"\n") and not more:
            data += b"\n"
            end = len(data) - 1
        else:
            data = data[: data.rfind(b"\n") + 1]
            end = len(data)
        if data:
            parts = data.split(b"\n")[:-1]
            if len(parts) > lines:
                parts = parts[:lines]
                end = sum(len(x) + 1 for x in parts)
            return [x.decode("utf-8", "replace") for x in parts], {**state, "offset": state["offset"] + end}
        if not closed:
            return [], state
        k += 1
        state |= {"inode": inodes[k], "offset": 0}


def pending_bytes(path: str, state: dict) -> int:
    """Bytes that are not read yet."""
    files = _files(path)
    inodes = [p.stat().st_ino for p in files]
    k = inodes.index(state["inode"]) if state.get("inode") in inodes else -1
    return sum(p.stat().st_size - (min(state["offset"], p.stat().st_size) if n == k else 0) for n, p in enumerate(files) if n >= k)


def follow(path: str, state: dict, ship: Callable[[list[str]], None], save: Callable[[dict], None], idle: float = 1.0, longest: float = 30.0, until: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Ship batch after batch until ``until()``: idle for a while where there is nothing, ever longer after failures.

    ``status`` in the state counts what was shipped, failures in a row and the last error;
    it is saved with the place after each batch, so totals survive a restart.
    """
    status = {"shipped_total": 0, "consecutive_failures": 0, "last_error": None, **state.get("status", {})}
    while not until():
        lines, after = read(path, state)
        if not lines:
            state = {**after, "status": status}
            sleep(idle)
            continue
        try:
            ship(lines)
        except Exception as e:  # the place stays, the batch comes again
            status = {**status, "consecutive_failures": status["consecutive_failures"] + 1, "last_error": str(e)[:500]}
            sleep(min(longest, 2.0 ** min(status["consecutive_failures"] - 1, 30)))
            continue
        status = {**status, "shipped_total": status["shipped_total"] + len(lines), "consecutive_failures": 0, "last_error": None, "last_ok_ts": time.time()}
        state = {**after, "status": status}
        save(state)
    return state


def health(path: str, state: dict) -> dict:
    """What a health check answers."""
    return {"status": "ok", "log_sync": {"pending_bytes": pending_bytes(path, state), **state.get("status", {})} if os.path.exists(path) else None}
