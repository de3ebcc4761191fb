"""Both spellings of method names."""

from __future__ import annotations

import re
from typing import Any


class CamelCase:
    """Method names in camelCase work too."""

    def __getattr__(self, name: str) -> Any:
        snake = re.sub(r"(?<=[a-z0-9])([A-Z])|(?<=[A-Z])([A-Z])(?=[a-z])", lambda m: "_" + m[0].lower(), name).lower()
        if snake != name and hasattr(type(self), snake):
            return getattr(self, snake)
        raise AttributeError(name)
