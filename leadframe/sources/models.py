"""Models behind HTTP as providers: chats, images with a prompt, and layouts of pages.

Each takes a transport, a function (url, headers, body, timeout) -> bytes, so tests and closed networks bring their own;
the default one uses the standard library. A failed call answers null and stops nobody."""

from __future__ import annotations

import json
import os
import urllib.request
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from ..functions.text import unfenced_text

Transport = Callable[[str, dict, bytes, float], bytes]
#: Where a credential is looked for if none is given, in this order.
CREDENTIALS = ("LEADFRAME_API_KEY", "CHAT_API_KEY")


class MissingCredential(ValueError):
    pass


def credential(given: str | None = None, environment: Mapping[str, str] | None = None, names: tuple[str, ...] = CREDENTIALS) -> str:
    """The given one, else the first that the environment has under one of the names."""
    environment = os.environ if environment is None else environment
    found = given or next((environment[n] for n in names if environment.get(n)), None)
    if not found:
        raise MissingCredential(f"no credential was given, and none of {', '.join(names)} is set")
    return found


def http(url: str, headers: dict, body: bytes, timeout: float) -> bytes:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read()


@dataclass
class Options:
    """Of a call: the caller's own values take the place of these."""

    url: str = ""
    model: str = "llama-3"
    temperature: float = 0.0
    max_tokens: int = 8192
    timeout: float = 120.0
    api_key: str | None = None
    headers: dict = field(default_factory=dict)

    def changed(self, **values) -> Options:
        return Options(**{**self.__dict__, **values})

    @property
    def identity(self) -> str:
        """What answers depend on: no key, no timeout."""
        return json.dumps([self.url, self.model, self.temperature, self.max_tokens])


@dataclass
class Chat:
    """Answers a request, which is a list of messages as JSON, with the text of the first choice."""

    options: Options
    transport: Transport = http

    @property
    def identity(self) -> str:
        return f"chat {self.options.identity}"

    def prepared(self) -> Chat:
        """With the credential that this process finds, so that executors need none of their own; raises if there is none."""
        return Chat(self.options.changed(api_key=credential(self.options.api_key)), self.transport)

    def answer(self, request: str, image: bytes | None = None) -> str | None:
        o = self.options
        body = {"model": o.model, "messages": json.loads(request), "temperature": o.temperature, "max_tokens": o.max_tokens}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {credential(o.api_key)}", **o.headers}
        found = json.loads(self.transport(o.url, headers, json.dumps(body).encode(), o.timeout))
        return found["choices"][0]["message"]["content"]


def form(fields: dict[str, str], image: bytes, name: str = "page.png") -> tuple[str, bytes]:
    """(content type, body) of a form with these fields and an image."""
    mark = uuid.uuid4().hex
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    parts.append(f'--{mark}\r\nContent-Disposition: form-data; name="image"; filename="{name}"\r\nContent-Type: image/png\r\n\r\n'.encode() + image + b"\r\n")
    return f"multipart/form-data; boundary={mark}", b"".join(parts) + f"--{mark}--\r\n".encode()


@dataclass
class Vision:
    """Answers an image and a prompt with the service's whole response. Without an image there is nothing to ask."""

    options: Options
    transport: Transport = http

    @property
    def identity(self) -> str:
        return f"{type(self).__name__} {self.options.identity}"

    def answer(self, request: str, image: bytes | None = None) -> str | None:
        if image is None:
            return None
        kind, body = form({"prompt": request, "output_token": str(self.options.max_tokens)}, bytes(image))
        return self.transport(self.options.url, {"Content-Type": kind, **self.options.headers}, body, self.options.timeout).decode()


class LayoutVision(Vision):
    """As Vision, but answers with the text under `description`, without fences; what isn't such JSON, as it is."""

    def answer(self, request: str, image: bytes | None = None) -> str | None:
        raw = super().answer(request, image)
        if raw is None:
            return None
        try:
            described = json.loads(raw)["description"]
        except (ValueError, KeyError, TypeError):
            return raw
        return unfenced_text(described) if isinstance(described, str) else raw
