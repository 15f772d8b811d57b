"""Continuous versions of the two detections that suit a stream."""
