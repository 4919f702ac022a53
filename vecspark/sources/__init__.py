"""Readers, generators and result stores."""
