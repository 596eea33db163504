"""Readers and writers of images, nested results, metrics, plot frames, configurations and models."""
