"""Reading exports into typed tables and writing tables and documents back."""
