"""Readers of raw measurement reports, point clouds, contour words and extracted text."""
