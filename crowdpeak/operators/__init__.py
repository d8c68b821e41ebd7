"""DataFrame operators. Every table has a `video_id` key; times are seconds from the start of the recording."""
