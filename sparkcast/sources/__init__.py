"""Reading series and writing results."""
