"""A run's ledger: which steps are done, on which inputs, with which results; gates for promotion, and a seal for tests that may be looked at once."""

from __future__ import annotations

import hashlib
import json
import os
import time


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Run:
    """A folder with a manifest. A step that is complete with the same inputs is done; a changed input undoes it."""

    def __init__(self, folder: str, config: dict | None = None):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        self.path = os.path.join(folder, "manifest.json")
        self.state = {"config": config or {}, "steps": {}}
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                self.state = json.load(f)
            if config is not None and self.state["config"] != config:
                raise ValueError("the folder belongs to a run with another configuration")
        self._save()

    def _save(self) -> None:
        """Under another name first, so a reader never sees half a manifest."""
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(self.state, f, indent=1, sort_keys=True)
        os.replace(self.path + ".new", self.path)

    def done(self, step: str, inputs: list[str] = ()) -> bool:
        entry = self.state["steps"].get(step)
        return bool(entry) and entry["inputs"] == {p: file_digest(p) for p in inputs if os.path.exists(p)} and len(entry["inputs"]) == len(inputs)

    def complete(self, step: str, inputs: list[str] = (), **facts) -> None:
        self.state["steps"][step] = {"inputs": {p: file_digest(p) for p in inputs}, "facts": facts, "at": time.strftime("%Y-%m-%dT%H:%M:%S")}
        self._save()

    def note(self, text: str) -> None:
        with open(os.path.join(self.folder, "notes.txt"), "a", encoding="utf-8") as f:
            f.write(text.rstrip("\n") + "\n")


def promoted(before: dict[str, float], after: dict[str, float], gates: dict[str, float]) -> dict[str, bool]:
    """For each metric whether it rose by its gate at least (a negative gate is how far it may fall). A metric that is missing on a side fails."""
    return {m: m in before and m in after and after[m] - before[m] >= least - 1e-12 for m, least in gates.items()}


def sealed(folder: str, name: str, look) -> object:
    """look()'s result, once: a second call under the name is refused, also after a crash inside look."""
    lock = os.path.join(folder, f"{name}.sealed")
    try:
        fd = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise PermissionError(f"{name} was looked at before") from None
    os.close(fd)
    return look()
