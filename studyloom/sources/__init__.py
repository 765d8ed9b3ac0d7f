"""Sources: adapters from files to block rows, and readers of the engine's own artefacts."""

from studyloom.sources.adapters import adapter_for, available_extensions, load, register  # noqa: F401
