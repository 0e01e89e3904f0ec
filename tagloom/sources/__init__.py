"""Reading documents and tables into trees and node rows."""
