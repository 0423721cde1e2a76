"""Readers and writers of sequence files, spectra, corrections and run logs."""
