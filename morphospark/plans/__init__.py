"""Jobs chaining operators (E1-E5 of the survey) and the driver catalog."""
