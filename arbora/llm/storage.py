"""The library's tables in the shared folder."""

from ..storage import Workspace, shared_dir

__all__ = ["Workspace", "shared_dir"]
