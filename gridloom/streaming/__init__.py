"""Maps and poses that grow with a stream."""

from .live import fold_poses, max_merge_sink, pose_stream

__all__ = ["fold_poses", "max_merge_sink", "pose_stream"]
