"""Whole crawls, round by round."""
